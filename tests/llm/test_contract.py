"""Every registered query on a small folder: names, types and values; and columns with the operators' own names."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from twinlake.llm import cotraining  # noqa: E402
from twinlake.llm.chunk_bpe import encode_texts  # noqa: E402
from twinlake.llm.cotraining import quality_scores  # noqa: E402
from twinlake.llm.host_quality import host_quality  # noqa: E402
from twinlake.llm.minhash_dedup import near_duplicates  # noqa: E402
from twinlake.llm.queries import QUERIES  # noqa: E402
from twinlake.llm.source_mix import mix_sources  # noqa: E402
from twinlake.llm.suffix_dedup import remove_repeats  # noqa: E402
from twinlake.llm.token_prefixes import count_prefixes  # noqa: E402
from twinlake.llm.vector_dedup import near_vectors  # noqa: E402

LIB = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PAGES = [(5, "u5", "<p>" + "é" * 200), (2, "u2", "<p>" + "é" * 200), (9, None, None), (1, "u", "x"), (3, "u", "x"), (4, "u", "")]


def _texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(120), text(150).split()
    near = [x if k != 70 else "other" for k, x in enumerate(base)]
    out = [text(60) + " " + passage + " " + text(30), passage + " " + text(90), " ".join(base), " ".join(near), " ".join(base)]
    out += [None, "", " \n\t ", "a b c", "a b c d e " * 30, "x\ny\nx\n# $5 <b>|é\x0bü", "<|endoftext|> it's", text(70_000)]  # over 256 KB
    return out + [text(80) for _ in range(20)]


TEXTS = _texts()


def _ids(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    rng = np.random.default_rng(2)
    c = rng.normal(size=64)
    vectors = [(k, (c + rng.normal(size=64) * (0.01 if k < 4 else 3)).tolist(), k % 2) for k in range(12)] + [(12, None, 1), (13, [0.0] * 64, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    labels = [(k, int(k % 3 > 0), 0) for k in range(len(TEXTS))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def _run(spark, folder, name, kinds):
    out = QUERIES[name](spark, folder)
    assert dict(out.dtypes).items() >= kinds.items()
    assert out.columns[: len(kinds)] == list(kinds)
    return [r for r in out.collect()]


def test_op1(spark, folder):
    rows = _run(spark, folder, "op1_suffix_array_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    raws = [(t or "").encode() for t in TEXTS]
    seen = Counter(t[i : i + 400] for t in raws for i in range(len(t) - 399))
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = raws[r.doc_id]
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i + 1 : i + 401] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert sum(r.n_spans for r in rows) >= 4


def test_op2(spark, folder):
    rows = _run(spark, folder, "op2_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    want = {(k, len((t or "").encode()), len(_ids(t)), len(_ids(t)) > 1024) for k, t in enumerate(TEXTS)}
    assert {tuple(r[:4]) for r in rows} == want


def test_op3(spark, folder):
    rows = _run(spark, folder, "op3_vector_dedup", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})
    got = {r.vec_id: tuple(r[1:]) for r in rows}
    assert got[0] == (1, 0, True) and got[2] == (1, 0, False) and got[3] == (1, 1, False)
    assert all(got[k] == (0, k, True) for k in range(4, 14))


def test_op4(spark, folder):
    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    got = {r.page_id: tuple(r[1:]) for r in _run(spark, folder, "op4_warc", kinds)}
    for k, _, html in PAGES:
        raw = (html or "").encode()
        said = ("revisit", 2) if k == 5 else ("response", None)
        assert got[k] == (len(raw), hashlib.sha256(raw).hexdigest(), *said)


def test_op5(spark, folder):
    kinds = {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    rows = _run(spark, folder, "op5_source_mix", kinds)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in TEXTS]
    source = [f"s{k % 3}" if k % 4 else None for k in range(len(TEXTS))]
    total = Counter()
    for k, n in enumerate(words):
        total[source[k]] += n
    names = [*sorted(s for s in total if s), None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, open_ = {}, sum(words), set(names)
    while over := [s for s in open_ if weight[s] * left / sum(weight[o] for o in open_) > 3 * total[s]]:
        s = min(over, key=lambda s: total[s] / weight[s])
        target[s], left = 3.0 * total[s], left - 3 * total[s]
        open_.remove(s)
    target |= {s: weight[s] * left / sum(weight[o] for o in open_) for s in open_}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (words[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in names)


def test_op6(spark, folder):
    kinds = {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint"}
    for r in _run(spark, folder, "op6_host_quality", kinds | {"base_failed": "boolean", "kept": "boolean"}):
        t = TEXTS[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert tuple(r[1:7]) == (*want, failed) and not (failed and r.kept)


def test_op7(spark, folder):
    kinds = {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    got, start = {r.doc_id: tuple(r[1:]) for r in _run(spark, folder, "op7_token_files", kinds)}, 0
    for k, t in enumerate(TEXTS):
        ids = [*_ids(t), 0]
        assert got[k] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op8(spark, folder):
    got = {r.doc_id: (r.class_id, r.kept) for r in _run(spark, folder, "op8_prob_minhash", {"doc_id": "bigint", "class_id": "bigint", "kept": "boolean"})}
    want = {k: (k, True) for k in range(len(TEXTS))} | {3: (2, False), 4: (2, False)}
    assert got == want


def test_op9(spark, folder):
    kinds = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    got = {r.doc_id: tuple(r[1:]) for r in _run(spark, folder, "op9_bpe_chunk_reuse", kinds)}
    for k, t in enumerate(TEXTS):
        ids = _ids(t)
        text = LIB.decode(ids, skip_special_tokens=False)
        assert got[k] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def _plain(text):
    """Distinct tokens of a text, as the classifier has them, without numpy."""
    return {t.lower() for t in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff \t\n\x0b\x0c\r]+", text or "")}


def test_op10(spark, folder, monkeypatch):
    kinds = {"doc_id": "bigint", "p_text": "double", "p_meta": "double", "score": "double", "kept": "boolean"}
    views = []
    train = cotraining.train
    monkeypatch.setattr(cotraining, "train", lambda *a, **k: views.append(train(*a, **k)) or views[-1])
    rows = _run(spark, folder, "op10_cotraining", kinds)
    v = views[0]
    place = {int(h): k for k, h in enumerate(v.words)}
    squash = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = TEXTS[r.doc_id] or ""
        hashes = [int(cotraining.features([x.encode()], [()])[1][0]) for x in _plain(t)] if len(t) < 10_000 else None
        if hashes is None:
            continue
        z = [sum(v.text.w[place[h]] for h in hashes if h in place) + v.text.b]
        owner, every, numbers, hashed = cotraining.features([t.encode()], [(f"s{r.doc_id % 3}" if r.doc_id % 4 else None, "en" if r.doc_id % 2 else None)])
        bins = [int((v.edges[k] <= numbers[0, k]).sum()) for k in range(len(v.edges))]
        at = [*hashed[0].tolist(), *((1 << cotraining.META_BITS) + k * (cotraining.BINS + 1) + b for k, b in enumerate(bins))]
        z.append(sum(v.meta.w[i] for i in at) + v.meta.b)
        taught = [sum(v.taught[0][int(h) >> 64 - cotraining.TAUGHT_BITS] for h in every) / (1 + len(every))]
        taught.append(sum(v.taught[1][i] for i in at) / (1 + len(at)))
        c = [x * p[0] + y * p[1] + p[2] for x, y, p in zip(z, taught, v.platt)]
        four = [a * w for x, y, p in zip(z, taught, v.platt) for a, w in ((x, p[0]), (y, p[1]))]
        want = (squash(c[0]), squash(c[1]), squash(sum(a * b for a, b in zip(four, v.both)) + v.both[4]))
        assert tuple(r[1:4]) == pytest.approx(want, abs=1e-9) and r.kept == (want[2] >= 0.5)


OWN = ["doc", "hit", "cut", "raw", "digest", "rep", "own_id", "class", "part", "bucket", "held", "words", "lined", "grams", "places", "key", "counted", "least", "row", "y", "n", "size", "x", "links", "component", "own", "own_label", "carried", "range", "upto"]


@pytest.mark.parametrize(
    ("call", "new"),
    [
        (lambda d, _: remove_repeats(d), {"removed_spans", "kept"}),
        (lambda d, _: count_prefixes(d, P.path("byte_bpe_50k.json")), {"n_tokens", "cuts"}),
        (lambda d, _: host_quality(d), {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"}),
        (lambda d, _: near_duplicates(d), {"class_id", "kept"}),
        (lambda d, _: encode_texts(d, P.path("byte_bpe_50k.json"), decoded="decoded"), {"ids", "decoded"}),
        (lambda d, labels: quality_scores(d, labels), {"p_text", "p_meta", "score", "kept"}),
        (lambda d, _: near_vectors(d), {"n_links", "component_id", "kept"}),
    ],
    ids=["op1", "op2", "op6", "op8", "op9", "op10", "op3"],
)
def test_other_columns_pass_through(spark, call, new):
    names = [n for n in OWN if n not in new] + ["Kept_"]
    rng = random.Random(3)
    text = " ".join(str(rng.random()) for _ in range(40))
    rows = [(k, t, "s", "en", k, [1.0, float(k)], 0, *(f"{k} {n}" for n in names)) for k, t in enumerate([text, text, None, "", "a b"])]
    kind = "doc_id long, text string, source string, lang string, vec_id long, embedding array<double>, label int"
    d = spark.createDataFrame(rows, kind + "".join(f", `{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    out = call(d, labels)
    assert set(out.columns) >= new | {n for n in names if n not in new}
    got = {tuple(r[n] for n in names) for r in out.collect()}
    assert got == {tuple(r[7:]) for r in rows}


def test_the_mix_carries_any_column(spark):
    d = spark.createDataFrame([(k, "a b c", "s", "v") for k in range(5)], "doc_id long, text string, source string, `key` string")
    assert {r.carried.key for r in mix_sources(d, carry=["doc_id", "key"]).collect()} == {"v"}


def test_long_words_and_texts(spark):
    long = "x" * 300_000 + " " + "ab" * 50_000
    df = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    (r,) = count_prefixes(df, P.path("byte_bpe_50k.json"), table=True).where("doc_id = 1").collect()
    counts = np.frombuffer(r.prefix_counts, "<u4")
    assert r.n_tokens == len(_ids(long)) and counts[999] == len(_ids(long[:1000])) and counts[300_500] == len(_ids(long[:300_501]))
    assert host_quality(df.withColumn("source", F.lit("s"))).where("doc_id = 1").first().word_chars == 400_000
    words = " ".join(f"w{k * k % 9973}" for k in range(60_000))
    df = spark.createDataFrame([(1, words), (2, words + " z"), (3, "short")], "doc_id long, text string")
    assert near_duplicates(df).where("class_id = 1").count() == 2


def test_nothing_outside_needs_llm():
    top = Path(__file__).resolve().parents[2]
    for p in [*top.glob("twinlake/*.py"), *(q for d in ("operators", "functions", "sources", "plans", "streaming") for q in (top / "twinlake" / d).rglob("*.py"))]:
        assert "twinlake.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
