"""The pipeline's stages on a whole small table, against plain models."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sightings.llm import bpe, mixing, shingles, simhash, storage, token_files
from sightings.llm.queries import QUERIES, tokenizer_path

from .conftest import DOCUMENTS, clashing, odd_rows, prose, rows_of
from .test_operators import plain_hits

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_first(rows):
    """The smallest id of each group that pairs of a Jaccard similarity of 0.8 link."""
    sets, root = [plain_shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return set(least.values())


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = corpus_pipeline.select_quality(spark, docs, SF)
    assert kept.columns == columns
    rows = [tuple(r) for r in kept.collect()]
    first = plain_first(rows)
    kept = corpus_pipeline.drop_near_copies(spark, kept, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first)
    clean = {r[0] for r in rows if r[0] in first and not plain_hits(r[1], items)[-1]}
    kept = corpus_pipeline.drop_contaminated(spark, kept, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(clean)
    times = {r["doc_id"]: r["reps"] for r in mixing.repetitions(kept).collect()}
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    assert mixed.columns == columns
    texts = {r[0]: r[1] for r in rows}
    from tokenizers import Tokenizer

    t, want, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for d in sorted(times):
        ids = np.array(t.encode(texts[d], add_special_tokens=False).ids + [0], "<u4")
        for _ in range(times[d]):
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


@pytest.mark.parametrize("rows", [[], odd_rows()], ids=["empty", "odd"])
def test_stages_take_odd_tables(spark, rows):
    docs = clashing(spark.createDataFrame(rows, DOCUMENTS))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != "token files":
            assert got.columns == docs.columns
        assert rows or got.count() == 0
        got.count()


def test_near_copies_go_by_jaccard(spark):
    """Pairs at 0.8 and above whose fingerprints are far apart, chains, and pairs just below."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        words = prose(900 + k, 200 + 5 * k).split(" ")
        rows.append((10 * k, " ".join(words), "en", "a", 0))
        for j in range(1, 5):
            words = list(words)
            for at in rng.choice(len(words), 1 + k // 5, replace=False):
                words[at] = f"new{k}x{j}x{at}"
            rows.append((10 * k + j, " ".join(words), "en", "a", 0))
    passage = prose(77, 60)
    rows += [(1000 + k, f"{passage} {prose(2000 + k, 60)}", "en", "b", 0) for k in range(60)]
    rows += [(2000 + k, f"{prose(3000, 100)} tail{k}", "en", "b", 0) for k in range(60)]
    rows += [(3000, None, None, None, 0), (3001, "", None, None, 0), (3002, "one two", None, None, 0), (3003, "One  two", None, None, 0)]
    wide = 0
    for i, x in enumerate(rows[:200]):
        for y in rows[:i]:
            one, other = plain_shingles(x[1]), plain_shingles(y[1])
            if len(one & other) >= 0.8 * len(one | other):
                wide += bin(simhash.fingerprint(x[1]) ^ simhash.fingerprint(y[1])).count("1") > 4
    assert wide > 20
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    want = sorted(plain_first(rows))
    groups = shingles.similar_groups(docs, block=4)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs, groups).collect()) == want
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == want


def test_parity_bits_never_overstate():
    rng = np.random.default_rng(8)
    for n, m, both in ((0, 0, 0), (1, 0, 0), (40, 50, 30), (700, 900, 650), (5000, 4100, 4000)):
        h = rng.integers(0, 1 << 63, n + m, np.uint64)
        x, y = np.unique(h[:n]), np.unique(np.concatenate([h[:both], h[n : n + m - both]]))
        apart = len(np.setxor1d(x, y))
        least = shingles.least_difference(shingles.parity(x), shingles.parity(y))
        assert least <= apart and least >= apart // 4


def test_workers_keep_no_encoder_after_the_token_files(spark):
    """Workers take turns, so what each keeps would add up."""

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(storage.kept(bpe.KIND))] * b.num_rows, pa.int64())})

    mixed = spark.createDataFrame(odd_rows() * 2, DOCUMENTS).repartition(8)
    want = rows_of(token_files.token_digests(mixed, tokenizer_path()).drop("name"))
    folder, files = token_files.write(mixed, tokenizer_path(), keep=False)
    # Before the files are read, as that step would drop what others keep.
    assert {r["n"] for r in spark.range(0, 32, 1, 32).mapInArrow(held, "n long").collect()} == {0}
    assert rows_of(token_files.digests(folder, files).drop("name")) == want
