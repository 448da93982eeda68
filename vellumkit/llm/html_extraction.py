"""Main text of a web page from text-to-tag ratios.

The standard library's parser streams its events; a line ends at each line break and at each tag that starts or ends a block.
The ratio of a line is its characters of text over its tags (1 at least); script, style and the like add neither. The
ratios are smoothed with a Gaussian over the lines, and the lines whose smoothed ratio reaches the threshold, ``LAMBDA``
standard deviations of the smoothed ratios, cluster into content regions. Lines of text inside a region are the content.
Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import prepare

BLOCKS = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
#: Their text isn't shown on the page.
SKIPPED = frozenset("script style noscript template textarea select title".split())
SIGMA, RADIUS, LAMBDA = 1.0, 2, 0.5
KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
SCHEMA = "text string, n_lines int, n_content_lines int, threshold double"


class Lines(HTMLParser):
    """Collects (text, number of tags) of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.skip: str | None = None

    def end_line(self) -> None:
        if self.parts or self.tags:
            self.lines.append((" ".join("".join(self.parts).split()), self.tags))
            self.parts, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip:
            return
        if tag in SKIPPED:
            self.skip = tag
            return
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip or tag in ("head", "body", "html"):  # an element left open ends with its page's part
                self.skip = None
            return
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        head, *rest = data.split("\n")
        self.parts.append(head)
        for x in rest:
            self.end_line()
            self.parts.append(x)


def lines_of(html: str) -> list[tuple[str, int]]:
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    return p.lines


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Weighted mean over the lines within RADIUS; at the ends, over those there are."""
    n = len(ratio)
    padded, there = np.pad(ratio, RADIUS), np.pad(np.ones(n), RADIUS)
    up = sum(k * padded[i : i + n] for i, k in enumerate(KERNEL))
    return up / sum(k * there[i : i + n] for i, k in enumerate(KERNEL))


def extract(html: str | None) -> tuple[str | None, int, int, float]:
    """(content, lines, lines of content, threshold). None for None; '' for a page without text."""
    if html is None:
        return None, 0, 0, 0.0
    lines = lines_of(html)
    if not lines:
        return "", 0, 0, 0.0
    ratio = smoothed(np.array([len(t) / max(1, tags) for t, tags in lines], np.float64))
    threshold = LAMBDA * float(ratio.std())
    keep = [t for (t, _), r in zip(lines, ratio) if t and r >= threshold and r > 0]
    return "\n".join(keep), len(lines), len(keep), threshold if math.isfinite(threshold) else 0.0


def _extracted(column: str) -> F.Column:
    @F.pandas_udf(SCHEMA)
    def extracted(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h) for h in pages], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return extracted(F.col(column).cast("string"))


def html_extraction(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines, n_content_lines, threshold) for each row, repeated ones too.

    A null page has a null text; an empty page, or one without visible text, has the text ''. Pages that aren't HTML are lines
    of text without tags. Broken markup is read as the parser recovers it. Whole pages of any length are read.
    """
    prepare(pages.sparkSession)
    return pages.select("page_id", _extracted("html").alias("x")).select("page_id", "x.text", "x.n_lines", "x.n_content_lines", F.round("x.threshold", 6).alias("threshold"))
