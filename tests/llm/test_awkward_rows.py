"""Null, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest

from roamlens.llm import benchmark, credentials, lines, minhash, mixing, pii, quality, subwords, suffix, voters

LABELS = "doc_id long, quality int, toxic int"


def _labels(spark, docs):
    return spark.createDataFrame([(1, 0, 0), (2, 1, 1), (4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (6, 1, 0)], LABELS)


def _items(spark):
    return spark.createDataFrame([(0, "word1 item1 word2 item2 word3 item3 word4 item4"), (None, None), (2, "")], "item_id long, text string")


EACH = {
    "quality": lambda s, d: quality.judge(d), "suffix": lambda s, d: suffix.repeated_bytes(d), "minhash": lambda s, d: minhash.near_duplicates(d),
    "credentials": lambda s, d: credentials.scan(d), "mixing": lambda s, d: mixing.mixed(d), "lines": lambda s, d: lines.dedup_lines(d),
    "pii": lambda s, d: pii.pseudonymised(d), "subwords": lambda s, d: subwords.classify(d, _labels(s, d)), "voters": lambda s, d: voters.classify(d, _labels(s, d)),
}
FILTERS = {
    "quality": lambda s, d: quality.good_documents(d), "lines": lambda s, d: lines.without_repeated_lines(d), "minhash": lambda s, d: minhash.keep_one_of_each(d),
    "benchmark": lambda s, d: benchmark.clean_of(d, _items(s)),
}


@pytest.mark.parametrize("name", EACH)
def test_a_row_for_every_row(spark, awkward, name):
    assert len(EACH[name](spark, awkward).collect()) == 12


@pytest.mark.parametrize("name", EACH)
def test_empty_table(spark, nothing, name):
    assert EACH[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, awkward, nothing, name):
    out = FILTERS[name](spark, awkward)
    assert out.columns == awkward.columns and [t for _, t in out.dtypes] == [t for _, t in awkward.dtypes]
    assert 0 < out.count() <= 12
    assert FILTERS[name](spark, nothing).collect() == []


def test_copies_and_wordless_rows(spark, awkward):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(awkward).collect()]
    assert got.count((6, 1, 6, True)) == 2 and (1, 0, 1, True) in got and (2, 0, 2, True) in got
    assert {r[2] for r in got if r[0] in (4, 5)} == {4}
    assert sorted(r.doc_id for r in minhash.keep_one_of_each(awkward).collect() if r.doc_id in (4, 5, 6)) == [4, 6]


def test_base_rule_on_wordless_rows(spark, awkward):
    got = {r.doc_id: r for r in quality.judge(awkward).collect()}
    assert got[1].base_failed and not got[1].kept and got[1].n_words == 0
    assert got[4].n_words == 60_000 and not got[4].base_failed
