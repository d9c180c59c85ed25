"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import collections
import random

import pytest

import corpus_pipeline as c
from texloom.llm import pii
from texloom.llm.common import stage
from tests.llm.test_small import WORDS, all_ids, brute_components, plain_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, f in c.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert [n for n, _ in c.STAGES] == ["quality_rules", "near_copies", "personal_data", "mixing", "packing"]


def test_rules(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    for r in stages[0].collect():
        n = plain_counts(r["text"])
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            assert r["doc_id"] not in kept
    assert len(kept) > 0.6 * stages[0].count()


def test_copies(stages):
    want = brute_components([(r["doc_id"], r["text"]) for r in stages[1].collect()])
    assert {r["doc_id"] for r in stages[2].collect()} == {root for _, root in want.values()}


def test_masking(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        assert pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not pii.DIGITS.search(before[r["doc_id"]]) and "@" not in before[r["doc_id"]]:
            assert r["text"] == before[r["doc_id"]]


def test_mix_and_pack(stages):
    times = collections.Counter(r["doc_id"] for r in stages[4].collect())
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in stages[3].collect()}
    pieces = stages[5].collect()
    whole = collections.Counter()
    for r in pieces:
        whole[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert {d: n * tokens[d] for d, n in times.items()} == dict(whole)


def test_run(spark, stages):
    assert c.run(spark, SF).count() == stages[-1].count()


def test_an_id_on_two_texts(spark):
    alone, copied = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, alone), (5, copied), (3, copied), (7, alone + " tail"), (8, copied), (9, "one other text of six words"), (9, "one other text of six words"), (None, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = c.drop_near_copies(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame([(5, alone), (3, copied), (9, rows[5][1]), (None, copied)], docs.schema).collect()))

@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, a repeated row, and extra columns named as those that stages make."""
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))
    texts = [prose(60) for _ in range(14)]
    near = texts[2].split()
    near[30] = "changed"
    texts += [" ".join(near), texts[3].upper(), prose(30_000), "", " \n\t", None, "too few words", "la " * 50, prose(40) + " mail a.b@c.example.com or call +1 (269) 555-3296 today"]
    rows = [(k, t, "en" if k % 4 else None, f"s{k % 3}" if k % 5 else None, len(t or "") if k % 6 else None) for k, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, prose(50), "en", "s1", 1), (None, texts[4], None, None, None), (None,) * 5]
    extra = [(True, k, None if k % 2 else k, k, False, "g", 0.5, k, 1.0, k, b"x") for k in range(len(rows))]
    names = "kept boolean, size long, taken long, component_id long, gone boolean, `set` string, key double, hash long, rest double, source_size long, ids binary"
    return spark.createDataFrame([a + b for a, b in zip(rows, extra, strict=True)], f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3).cache()


@pytest.fixture(scope="module")
def no_labels(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_odd_rows(spark, odd, no_labels):
    out = [odd]
    for name, f in c.STAGES:
        out.append(stage(f(spark, out[-1], no_labels), name))
    assert all(d.columns == odd.columns for d in out[:-1])
    rows = [[r.asDict() for r in d.collect()] for d in out]
    # Without labels only the base rules count; whole rows pass unchanged.
    def fine(t):
        n = plain_counts(t or "")
        return n[0] >= 10 and 100 * n[4] <= 20 * n[0]

    plain = lambda found: sorted(map(str, found))
    assert plain(rows[1]) == plain(x for x in rows[0] if fine(x["text"]))
    # The least id of each group, once; rows without an id stay.
    roots = {root for _, root in brute_components([(x["doc_id"], x["text"]) for x in rows[1] if x["doc_id"] is not None]).values()}
    named = [x["doc_id"] for x in rows[2] if x["doc_id"] is not None]
    assert sorted(named) == sorted(roots) and 14 not in roots and 15 not in roots
    assert plain(x for x in rows[2] if x["doc_id"] is None) == plain(x for x in rows[1] if x["doc_id"] is None)
    # Masked texts, nothing else.
    masked = {x["doc_id"]: x for x in rows[3]}
    assert masked[22]["text"].endswith("mail <EMAIL> or call <PHONE> today") and len(rows[3]) == len(rows[2])
    assert all(x["n_chars"] == len(x["text"]) for x in rows[3])
    assert plain({**x, "n_chars": 0} for x in rows[3] if x["doc_id"] != 22) == plain({**x, "n_chars": 0} for x in rows[2] if x["doc_id"] != 22)
    # Whole documents, twice at most, and every token of theirs once.
    before, after = collections.Counter(map(str, rows[3])), collections.Counter(map(str, rows[4]))
    assert set(after) <= set(before) and all(n <= 2 * before[x] for x, n in after.items())
    times, tokens = collections.Counter(x["doc_id"] for x in rows[4]), collections.Counter()
    for x in rows[5]:
        tokens[x["doc_id"]] += x["length"]
    sizes = collections.Counter()
    for x in rows[4]:
        sizes[x["doc_id"]] += len(all_ids(WORDS, [x["text"]])[0])
    assert tokens == sizes and set(times) == set(tokens)


def test_stages_on_no_rows(spark, odd, no_labels):
    docs = odd.where("false")
    for name, f in c.STAGES:
        docs = stage(f(spark, docs, no_labels), name)
        assert docs.count() == 0
        assert name == "packing" or docs.columns == odd.columns
