"""Visible text of HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = {"style", "script", "head", "title", "meta", "[document]"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.pieces = ["[document]"], []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open[1:]:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.open[-1] not in HIDDEN:
            self.pieces.append(data.strip())


def visible(html: str | None) -> str | None:
    """Stripped text pieces joined by a space; the input itself if nothing is visible."""
    if html is None:
        return None
    p = _Visible()
    p.feed(html)
    p.close()
    return " ".join(p.pieces) or html


@F.pandas_udf(T.StringType())
def visible_text(s: pd.Series) -> pd.Series:
    return s.map(visible, na_action="ignore")
