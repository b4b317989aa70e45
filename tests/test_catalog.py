"""Every core query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

from quarrymill.functions.checks import ContractError
from quarrymill.operators import dense
from quarrymill.plans import catalog
from quarrymill.plans.engine import Engine
from quarrymill.sources.files import HybridSettings
from quarrymill.sources.tables import VersionedTable

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())


def test_engine(spark, tmp_path):
    e = Engine(spark, DATA)
    assert all(e.readiness().values())
    found = e.search("escaped ledger review", limit=3).collect()
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and found
    assert found[0].bm25.matched_terms and found[0].dense is None and found[0].semantics
    assert e.index() is e.index()
    kept = e.search("escaped ledger review", limit=50, statuses=["valid"]).collect()
    assert kept and {r.validation_status for r in kept} == {"valid"}
    one, listed = e.detail(1)
    assert one.count() <= 1 and listed.count() >= 0
    assert set(e.stats()) == {"overview", "validation", "licenses", "tools"}
    with pytest.raises(ValueError):
        e.search(" ")


def test_engine_compares_vectors_of_one_model_only(spark, tmp_path):
    with pytest.raises(ContractError, match="no vectors"):
        Engine(spark, DATA).search("escaped ledger", mode="dense")  # the stored vectors are of another model
    with pytest.raises(ContractError, match="no encoder"):
        Engine(spark, DATA, HybridSettings(model_id=catalog.MODEL, model_revision=catalog.REVISION)).search("escaped ledger", mode="hybrid")
    e = Engine(spark, DATA, vectors=VersionedTable(spark, "file://" + str(tmp_path / "v")))
    with pytest.raises(ContractError):
        e.search("escaped ledger", mode="dense")
    assert e.index_dense() > 0 and e.index_dense() == 0
    text = spark.read.parquet(DATA + "/corpus_documents.parquet").where("validation_status = 'valid' and length(body_text) > 100").first()
    found = e.search(text.description_text[:400], mode="dense", limit=5).collect()
    assert len(found) == 5 and all(abs(r.dense.cosine_similarity + r.dense.cosine_distance - 1) < 1e-9 for r in found)
    assert text.document_id in {r.document_id for r in e.search(text.description_text[:400], mode="hybrid", limit=10).collect()}
    late = Engine(spark, DATA, HybridSettings(model_id=dense.HASHING, model_revision="2"), e.vectors)
    with pytest.raises(ContractError, match="no vectors"):
        late.search("escaped ledger", mode="dense")


def test_ranked_documents_must_be_stored(spark, tmp_path):
    import shutil

    for name in ("repositories", "skills", "corpus_documents"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    e = Engine(spark, str(tmp_path))
    first = e.search("escaped ledger review", limit=1).first()
    kept = spark.read.parquet(DATA + "/skills.parquet").where(f"document_id <> '{first.document_id}'")
    kept.coalesce(1).write.parquet(str(tmp_path / "fewer"))
    os.unlink(tmp_path / "skills.parquet")
    os.rename(tmp_path / "fewer", tmp_path / "skills.parquet")
    spark.catalog.refreshByPath(str(tmp_path / "skills.parquet"))
    with pytest.raises(ContractError, match="not stored"):
        Engine(spark, str(tmp_path)).search("escaped ledger review", limit=1)
