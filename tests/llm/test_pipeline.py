"""The pipeline's stages against their operators' brute-force versions, and the entry point without the package."""

import subprocess
import sys

import numpy as np
import pytest

from llm_cases import SF
from test_near_dedup import brute

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline as C  # noqa: E402

from logsift.llm import pieces, quality  # noqa: E402
from logsift.session import materialize  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    start = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "pii", "pieces"]
    out = {}
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = {r.doc_id: r for r in docs.collect()}
        assert len(out[name]) == docs.count()
        if name != "pieces":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = start.keys() - out["quality"].keys()
    assert all(labels.get(i, 0) == 0 for i in gone) and all(out["quality"][i] == start[i] for i in out["quality"])
    kept = brute([(i, r.text) for i, r in out["quality"].items()])
    assert out["near_dedup"].keys() == {i for i, (_, c, k) in kept.items() if k}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert out["decontaminate"].keys() == {i for i, r in out["near_dedup"].items() if not any(t in r.text for t in items)}
    assert out["pii"].keys() == out["decontaminate"].keys()
    for i, r in out["pii"].items():
        before = out["decontaminate"][i]
        assert (r.lang, r.source) == (before.lang, before.source) and (r.text == before.text or "[" in r.text)
        assert r.n_chars == (before.n_chars if r.text == before.text else len(r.text))
    model = pieces.pieces(pieces.MODEL)
    assert {i: list(r.ids) for i, r in out["pieces"].items()} == {
        i: np.frombuffer(model.encode(r.text), np.int32).tolist() for i, r in out["pii"].items()}


def test_null_text_and_repeated_rows(spark):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "mail a@b.cd now", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF), f"odd-{name}")
    # rows without a doc_id stay, and of a repeated row one does
    rows = {r.doc_id: list(r.ids) for r in docs.collect()}
    model = pieces.pieces(pieces.MODEL)
    assert docs.count() == 3 and rows == {1: [], 2: [], None: np.frombuffer(model.encode("mail [EMAIL] now"), np.int32).tolist()}


def test_filters_judge_rows_and_not_their_ids(spark):
    """Rows without a doc_id, or that share one, are rejected, leaking, copies or clean by their own text."""
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    fine = "the river was calm in the morning and the boats went out to the islands before noon"
    rows = clean.where("doc_id < 0").unionByName(spark.createDataFrame(
        [(None, item, "en", "s", 0), (1, item, "en", "s", 0), (1, fine, "en", "s", 0), (None, fine + " again", "en", "s", 0)], clean.schema))
    left = C.decontaminate_stage(spark, rows, SF)
    assert left.columns == clean.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, fine), (None, fine + " again")], key=str)
    # the quality stage: every row alone, with the id of another, or with none, fares alike
    docs = clean.where(clean.doc_id.isin(list(labels)[:80])).collect()
    nulls = spark.createDataFrame([(None, *r[1:]) for r in docs] + [(7, *r[1:]) for r in docs], clean.schema).unionByName(clean)
    kept = C.quality_stage(spark, nulls, SF).collect()
    by = {}
    for r in kept:
        by.setdefault(r.text, set()).add(r.doc_id)
    for r in docs:
        assert r.text not in by or {None, 7, r.doc_id} <= by[r.text]
    assert any(r.text not in by for r in docs) and any(r.text in by for r in docs)


@pytest.mark.parametrize("gone", ["logsift.llm", "corpus_pipeline"])
def test_entry_without_the_package(gone):
    code = (f"import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n"
            f"    def find_spec(self, name, path, target=None):\n"
            f"        if name == {gone!r} or name.startswith({gone + '.'!r}):\n"
            f"            raise ModuleNotFoundError(f'No module named {{name!r}}', name=name)\n"
            f"sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
            f"q = e.queries()\nassert 'syslog_parse' in q and 'pipeline' not in q and e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=C.__file__.rsplit("/", 1)[0])


def test_threshold_is_the_contracts():
    assert quality.THRESHOLD == 0.3
