"""URL filter: a weighted vocabulary of strict and soft terms, counted by an Aho-Corasick automaton.

A URL is decoded (percent escapes) and normalised to lower-cased runs of [a-z0-9], set apart by two spaces, and a term matches only
between boundaries: "sex" isn't found in "essex". One strict term rejects a URL, as do ``MIN_SOFT`` distinct soft terms whose weights
add up to ``MIN_WEIGHT``. The vocabulary is an argument; ``VOCABULARY`` is the one used if none is given. It doesn't grow with the
pages and goes out with the code; URLs are scanned where they are, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import prepare

_STRICT = """porn porno pornhub xxx xvideos xhamster xnxx redtube youporn hentai camgirls escorts milf nsfw bestiality casino casinos gangbang blowjob creampie deepthroat
camsex sexcam sexcams adult_cams adult_x adult_chat sex_tube sex_cam live_sex free_porn online_casino buy_viagra onlyfans_leak"""
#: Weight: terms.
_SOFT = {
    2.0: "sex", 1.5: "sexy nude nudes erotic erotica fetish viagra cialis levitra", 1.0: "adult adults hookup poker bets betting slots slot jackpot gambling roulette blackjack pills warez keygen spam popunder malware phishing bukkake lingerie swingers",
    0.5: "cams dating loans loan payday torrent torrents crack cracked serial replica ads adserver track tracker tracking clicks farm doorway pharma pharmacy proxy nulled", 0.25: "free cheap win winner bonus deal deals discount",
}
#: Weight of a term; None: strict.
VOCABULARY: dict[str, float | None] = {t.replace("_", " "): None for t in _STRICT.split()} | {t: w for w, terms in _SOFT.items() for t in terms.split()}
MIN_SOFT, MIN_WEIGHT = 2, 1.0
SCHEMA = "strict_hits int, soft_hits int, soft_distinct int, soft_weight double, rejected boolean"
_ESCAPE, _BREAK = re.compile("%([0-9a-f]{2})"), re.compile("[^a-z0-9]+")


def normalise(url: str) -> str:
    return f"  {_BREAK.sub('  ', _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url.lower()).lower())}  "


def _pattern(term: str) -> str:
    return f" {normalise(term).strip()} "


def automaton(vocabulary: dict[str, float | None] = VOCABULARY) -> ahocorasick.Automaton:
    """Its values are (term, weight). A term without letters or digits is left out."""
    auto = ahocorasick.Automaton()
    for t, w in vocabulary.items():
        if (p := _pattern(t)).strip():
            auto.add_word(p, (p, w))
    if len(auto):
        auto.make_automaton()
    return auto


def judge(url: str | None, auto: ahocorasick.Automaton, min_soft: int = MIN_SOFT, min_weight: float = MIN_WEIGHT) -> tuple[int, int, int, float, bool]:
    """(strict hits, soft hits, distinct soft terms, their weight, rejected); zeros and False for None."""
    strict, soft, terms = 0, 0, {}
    for _, (t, w) in auto.iter(normalise(url)) if url and len(auto) else ():
        if w is None:
            strict += 1
        else:
            soft += 1
            terms[t] = w
    weight = float(sum(terms.values()))
    return strict, soft, len(terms), weight, strict > 0 or (len(terms) >= min_soft and weight >= min_weight)


def _judged(url: str, vocabulary: dict[str, float | None], min_soft: int, min_weight: float) -> F.Column:
    @F.pandas_udf(SCHEMA)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = automaton(vocabulary)
        for urls in batches:
            yield pd.DataFrame([judge(u, auto, min_soft, min_weight) for u in urls], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return judged(F.col(url).cast("string"))


def url_filter(pages: DataFrame, vocabulary: dict[str, float | None] | None = None, min_soft: int = MIN_SOFT, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """(page_id, url, strict_hits, soft_hits, soft_distinct, soft_weight, rejected) for each row, repeated ones too.

    Hits count each occurrence; soft_weight adds the weights of the distinct soft terms. A null or empty URL has no hits
    and isn't rejected; with an empty vocabulary none is. URLs of any length are scanned whole; an escape that isn't one stays as it is.
    An empty table gives no rows. Other columns are not read.
    """
    prepare(pages.sparkSession)
    terms = VOCABULARY if vocabulary is None else vocabulary
    return pages.select("page_id", "url", _judged("url", terms, min_soft, min_weight).alias("j")).select("page_id", "url", "j.*")


def oracle_sql() -> str:
    """``url_filter`` over the table pages in DuckDB SQL."""

    def hits(term: str) -> str:
        p = _pattern(term)
        return f"((length(u) - length(replace(u, '{p}', ''))) // {len(p)})"

    soft_terms = {t: w for t, w in VOCABULARY.items() if w is not None}
    strict = " + ".join(hits(t) for t, w in VOCABULARY.items() if w is None)
    soft = " + ".join(map(hits, soft_terms))
    distinct = " + ".join(f"({hits(t)} > 0)::INT" for t in soft_terms)
    weight = " + ".join(f"({hits(t)} > 0)::INT * {w}::DOUBLE" for t, w in soft_terms.items())
    escape = "CASE WHEN i = 1 THEN p WHEN regexp_matches(left(p, 2), '^[0-9a-f]{2}$') THEN chr(('0x' || left(p, 2))::INT) || substr(p, 3) ELSE '%' || p END"
    return f"""
    WITH d AS (SELECT page_id, url, array_to_string(list_transform(string_split(lower(coalesce(url, '')), '%'), lambda p, i: {escape}), '') AS d FROM pages),
    n AS (SELECT page_id, url, '  ' || regexp_replace(lower(d), '[^a-z0-9]+', '  ', 'g') || '  ' AS u FROM d),
    c AS (SELECT page_id, url, ({strict})::INT AS strict_hits, ({soft})::INT AS soft_hits, ({distinct})::INT AS soft_distinct, ({weight})::DOUBLE AS soft_weight FROM n)
    SELECT *, strict_hits > 0 OR (soft_distinct >= {MIN_SOFT} AND soft_weight >= {MIN_WEIGHT}) AS rejected FROM c"""
