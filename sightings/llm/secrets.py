"""Secrets by corpus-wide ownership frequency (operator 8).

Three plain patterns find spans in each text. Beyond them every token that looks random is a
candidate. What decides about candidates is who holds them: the value's digest is counted by
distinct owners and repositories over the whole corpus. A value that many owners hold, or many
repositories of one owner, is a widely copied example; one that few hold is a live-looking
credential, and each of its occurrences becomes a span, with or without a keyword before it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.session import cut, ship

# The patterns of the three kinds and the least length of each, in their order.
# Letters of the first keyword are written out in both cases, as no other letters may match.
KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
LIVE = "live"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, _KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_KEYWORD = re.compile("|".join(map(_either_case, _KEYWORDS)))
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{%d,}" % MIN_HEX)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Bits per character that a candidate of digits and letters must have.
MIN_ENTROPY = 3.0
#: A value of more owners than this, or of more repositories, is an example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 4

_SPANS = "array<struct<kind:string,first:int,last:int,value_first:int,value_last:int,value:binary>>"


def entropy(value: str) -> float:
    """Bits per character of a value's own letters."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the value) of the three patterns, by start and kind."""
    out = []
    if _KEYWORD.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                out.append(("assign", m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                out.append(("access", m.start(), m.end(), m.start(), m.end()))
    for m in _HEX.finditer(text):
        out.append(("hex", m.start(), m.end(), m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens of 20 signs and more that hold a digit and a letter and look random."""
    out = []
    for m in _CANDIDATE.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= MIN_ENTROPY:
            out.append((m.start(), m.end()))
    return out


def _joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def found(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """Per row: row, doc_id, owner, repository, text_key, the base columns, all spans with digests."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(5):
                text = text.as_py() or ""
                base = base_spans(text)
                count = Counter(s[0] for s in base)
                values = {(s[3], s[4]) for s in base}
                more = [("", a, z, a, z) for a, z in candidates(text) if (a, z) not in values]
                rows.append(
                    {
                        "n_assign": count["assign"],
                        "n_access": count["access"],
                        "n_hex": count["hex"],
                        "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(),
                        "found": [
                            {
                                "kind": k,
                                "first": a,
                                "last": z,
                                "value_first": p,
                                "value_last": q,
                                "value": hashlib.sha256(text[p:q].encode("utf-8", "surrogatepass")).digest()[:16],
                            }
                            for k, a, z, p, q in base + more
                        ],
                    }
                )
            made = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], *made.columns],
                ["row", "doc_id", "owner", "repository", "text_key", *schema.names],
            )

    span = pa.struct(
        [("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()),
         ("value_first", pa.int32()), ("value_last", pa.int32()), ("value", pa.binary())]
    )
    schema = pa.schema(
        [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
         ("base_sha256", pa.string()), ("found", pa.list_(span))]
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(
        run,
        "row long, doc_id long, owner string, repository string, text_key long, n_assign long, n_access long, "
        f"n_hex long, base_sha256 string, found {_SPANS}",
    )


def ownership(spans: DataFrame) -> DataFrame:
    """value, owners, repositories: distinct holders of each value; unknown ones count as one.

    Repositories that hold copies of one text count once: `repositories` is the lesser of the
    distinct repositories and the distinct texts that have the value. Copies fall together
    before the shuffle.
    """
    held = spans.groupBy("value", "owner", "repository", "text_key").agg(F.count(F.lit(1)).alias("times"))
    known = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    counted = held.groupBy("value").agg(
        known("owner").alias("owners"), known("repository").alias("repositories"),
        known("text_key").alias("texts"), F.sum("times").alias("times"),
    )
    return counted.select("value", "owners", F.least("repositories", "texts").alias("repositories"), "times")


def secrets(
    docs: DataFrame,
    owner: str = "source",
    repository: str = "doc_id",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live.

    `spans` holds the spans of the three kinds, and a `live` one for each occurrence of a value
    that at most `max_owners` owners and `max_repositories` repositories hold in the whole corpus
    (see `ownership`): values of base spans, and random tokens that stand alone. It is ordered by start, then kind, `live` last, as
    kind:start:end in code points, end exclusive. Null text is empty and has no spans; a null
    owner is an owner of its own. Rows are handled one by one, also where ids repeat. Results
    are small; texts are read once, and what is found in them is kept in a table.
    """
    rows = cut(found(docs, owner, repository))
    holder = ["row", "owner", "repository", "text_key"]
    spans = rows.select(*holder, F.explode("found").alias("s")).select(*holder, "s.*")
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    live = ownership(spans).filter(few).select("value")
    extra = (
        spans.join(live, "value", "left_semi")
        .groupBy("row")
        .agg(F.collect_set(F.struct(F.col("value_first").alias("first"), F.col("value_last").alias("last"))).alias("live"))
    )
    order = {k: i for i, k in enumerate((*KINDS, LIVE))}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    base = F.transform(
        F.filter("found", lambda s: s["kind"] != ""),
        lambda s: F.struct(s["first"].alias("a"), rank[s["kind"]].alias("k"), s["last"].alias("z"), s["kind"].alias("n")),
    )
    more = F.transform(
        F.coalesce("live", F.array().cast("array<struct<first:int,last:int>>")),
        lambda s: F.struct(
            s["first"].alias("a"), F.lit(order[LIVE]).alias("k"), s["last"].alias("z"), F.lit(LIVE).alias("n")
        ),
    )
    text = F.transform(
        F.array_sort(F.concat(base, more)),
        lambda s: F.concat_ws(":", s["n"], s["a"].cast("string"), s["z"].cast("string")),
    )
    return rows.join(extra, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(text, ",").alias("spans"),
        F.size(more).cast("long").alias("n_live"),
    )
