import hashlib
import zlib

import pytest
from compare import connect, difference
from test_pii import literal

from fleetpulse.llm.queries import QUERIES, SQL

# columns and types that the results start with
SHAPES = {
    "op1": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7": "query_id bigint, rank int, vec_id bigint, score double",
    "op8": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op11": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op13": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    want = SHAPES[name.split("_")[0]].split(", ")
    assert [f"{n} {t}" for n, t in df.dtypes][: len(want)] == want
    if name in SQL:
        assert difference(df, connect(sf), SQL[name]) is None
    rows = df.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    if "doc_id" in df.columns:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name.startswith("op6"):
        for r in rows:
            spans = literal(docs[r.doc_id].text or "")
            assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
            text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
            assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    if "held_out" in df.columns:
        parts, at = (5, 0) if name.startswith("op3") else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == at) for r in rows)
    if name.startswith("op8"):
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
