"""Every registered query on tables whose rows are all equal, all null, or none."""

import hashlib
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from twinlake.llm.queries import QUERIES  # noqa: E402

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}
ROW = {
    "documents": (7, "Some words, more than once. " * 20, "en", "s", 560), "pages": (7, "http://a.example/x", "<p>Some text."),
    "embeddings": (7, [0.6, 0.8], 1), "conversations": (7, 1, "user", "Hello."), "labels": (7, 1, 0), "benchmark": (1, "x"),
}
TABLE_OF = {"op3": "embeddings", "op4": "pages", "op11": "pages", "op12": "conversations", "op13": "embeddings"}


@pytest.fixture(scope="module", params=["equal", "null", "none"])
def odd(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    for name, kind in TABLES.items():
        row = ROW[name] if request.param == "equal" else (None,) * len(ROW[name])
        rows = [] if request.param == "none" else [row] * 5
        spark.createDataFrame(rows, kind).repartition(2).write.parquet(f"{d}/{name}.parquet")
    return request.param, str(d)


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows_and_names(spark, odd, name):
    kind, d = odd
    rows = QUERIES[name](spark, d).collect()
    table = TABLE_OF.get(name.split("_")[0], "documents")
    if name.startswith("op13"):
        assert rows == []  # nothing spans a dimension
    elif name.startswith("op12"):
        # all of a conversation is one row
        assert len(rows) == (kind != "none")
        if kind == "equal":
            copies = {0: 0, 3: 10}.get(zlib.crc32(b"7:1") % 20, 5)
            assert rows[0].blank + rows[0].duplicate == max(0, copies - (zlib.crc32(b"7:1") % 20 != 1))
    else:
        assert len(rows) == (0 if kind == "none" else 5)
        own = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}[table]
        assert {r[own] for r in rows} <= {7 if kind == "equal" else None}


def test_token_files_of_equal_rows(spark, odd):
    """Ranges without rows give files without blocks."""
    kind, d = odd
    rows = QUERIES["op7_token_files"](spark, d).collect()
    text = ROW["documents"][1] if kind == "equal" else ""
    ids = [*Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0]
    crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in rows) == [(k * len(ids), len(ids), crc) for k in range(len(rows))]


def test_removed_and_kept_of_equal_rows(spark, odd):
    kind, d = odd
    if kind == "equal":
        (r,) = {tuple(r) for r in QUERIES["op1_suffix_array_dedup"](spark, d).collect()}
        assert r[1:5] == (len(ROW["documents"][1]), len(ROW["documents"][1]), 1, hashlib.sha256(b"").hexdigest())
