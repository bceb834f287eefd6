"""Near-duplicates, vectors, archives, the classifier and the pipeline."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from twinlake.llm import cotraining, shingles
from twinlake.llm.batches import segments as batches_segments
from twinlake.llm.cotraining import _chosen, _collect, _taught, _vocabulary, features, log_odds, quality_scores, train
from twinlake.llm.minhash_dedup import _open_links, near_duplicates
from twinlake.llm.shingles import prob_min_hash, probability_jaccard, weighted_shingles
from twinlake.llm.vector_dedup import near_vectors
from twinlake.llm.warc import archive, parse, read_warc, record, records, write_warc
from twinlake.session import shared_dir


def _bag(t, n=5):
    w = t.encode().split()
    k = min(n, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def _jp(x, y):
    both = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in both) for i in set(x) & set(y))


def _classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(0)
    est, want = [], []
    for _ in range(40):
        a = [f"w{rng.randint(0, 40)}" for _ in range(120)]
        b = [f"z{k}" if rng.random() < 0.05 else w for k, w in enumerate(a)]
        texts = [" ".join(a), " ".join(b)]
        doc, shingle, weight = weighted_shingles([t.encode() for t in texts])
        own = [(shingle[doc == k], weight[doc == k]) for k in (0, 1)]
        exact = probability_jaccard(*own)
        assert exact == pytest.approx(_jp(*map(_bag, texts)))
        sig = prob_min_hash(doc, shingle, weight, 2, 512)
        est.append((sig[0] == sig[1]).mean())
        want.append(exact)
    assert abs(np.mean(est) - np.mean(want)) < 0.01
    assert np.abs(np.array(est) - np.array(want)).max() < 0.1


@pytest.mark.parametrize("tile", [2048, 2])
def test_near_duplicates_equal_brute_force(spark, tile):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [[word() for _ in range(rng.randint(60, 200))] for _ in range(12)]
    for g, b in enumerate(base):
        for k in range(rng.randint(1, 12)):
            w = [word() if rng.random() < 0.01 * (k % 5) else x for x in b]
            rows.append((100 * g + k, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "one  two"), (5005, "one three")]
    rows += [(6000, rows[0][1]), (rows[1][0], rows[1][1]), (None, "one two"), (5003, rows[2][1]), (5003, "")]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, class_id int, digest string")
    got = near_duplicates(df, tile=tile).collect()
    assert len(got) == len(rows)
    bags = [(k, _bag(t or "")) for k, t in rows if k is not None]
    ids = sorted({k for k, _ in bags})
    linked = [(a, b) for a, x in bags for b, y in bags if a < b and x and y and _jp(x, y) >= 0.8]
    want = _classes(ids, linked)
    for r in got:
        assert r.class_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.class_id)
    assert near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("twice", [False, True])
def test_a_pair_at_the_threshold_is_linked(spark, twice):
    a = [f"w{k}" for k in range(94)]
    if twice:  # one shingle of weight two
        a[89:] = a[:5]
    b = [f"z{k}" if k in (30, 60) else w for k, w in enumerate(a)]
    texts = [" ".join(a), " ".join(b)]
    assert _jp(*map(_bag, texts)) == pytest.approx(0.8, abs=1e-12)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.class_id for r in got] == [0, 0]
    rows = [(b"b", 0, 0, 0, k == 0, k, k, bytes(640), t.encode()) for k, t in enumerate(texts)]
    kind = "bucket binary, i int, j int, band int, loose boolean, rep long, part long, sig binary, raw binary"
    assert [tuple(r) for r in _open_links(spark.createDataFrame(rows, kind), 32, 5, 5, 0.8).collect()] == [(0, 1)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        c = rng.normal(size=64)
        for k in range(rng.integers(1, 9)):
            v = c + rng.normal(size=64) * 0.02 * (k + 1) * np.linalg.norm(c) / 8
            rows.append((100 * g + k, [float(x) for x in v.astype(np.float32)], int(g % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 64, 1), (9003, [nan] + [1.0] * 63, 1), (9004, [inf] * 64, 1)]
    rows += [(9005, rows[0][1], None), (9006, rows[0][1], 0), (9007, rows[0][1][:32], 0), (9008, [None] + [1.0] * 63, 1)]
    rows += [(9009, [x * 3 for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    good = {}
    for k, v, label in rows:
        x = np.array([np.nan if y is None else y for y in v or []], float)
        if label is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
            good[k] = (label, x / np.linalg.norm(x))
    linked = [
        (a, b) for a, (la, x) in good.items() for b, (lb, y) in good.items()
        if a < b and la == lb and len(x) == len(y) and x @ y >= 0.98
    ]
    n = Counter(k for p in linked for k in p)
    want = _classes([r[0] for r in rows], linked)
    for k, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (n[k], want[k], want[k] == k), k
    assert near_vectors(df.where("false")).count() == 0
    twice = near_vectors(df.where("vec_id = 0").union(df.where("vec_id = 0"))).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in twice] == [(1, 0, True)] * 2


def test_archives_round_trip_with_a_dictionary_of_their_own():
    rng = random.Random(1)
    many = [("<html>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))).encode() for _ in range(900)]
    for some in (many, many[:2], [b"", b"x"], [b""], [b"x" * 5_000_000, b"y"]):
        assert list(records(b"".join(archive(some)))) == some
        head = next(archive(some))
        assert int.from_bytes(head[:4], "little") == 0x184D2A5D and len(head) > 8
    assert len(next(archive(many))) > 1000


def test_warc_pages(spark, tmp_path):
    long, short = "<p>" + "é" * 200, "tiny"
    rows = [(5, "u5", long), (2, "http://a\r\nb", long), (9, None, long), (1, "u", short), (3, "u", short), (4, "u", None), (6, "u", ""), (None, "u", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    uri = (tmp_path / "w").as_uri()
    got = {r.page_id: r for r in read_warc(write_warc(df, uri), uri).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        raw = (html or "").encode()
        r = got[k]
        assert (r.payload_length, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = k in (5, 9)
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == raw
    said, body = parse(record("response", 7, "u", "d" * 64, 3, None, b"a\r\n", "2020-01-01T00:00:00Z"))
    assert body == b"a\r\n" and said["WARC-Date"] == "2020-01-01T00:00:00Z" and said["WARC-Record-ID"].startswith("<urn:uuid:")
    again, none_ = parse(record("revisit", 8, "u", "d" * 64, 3, 7, b"", "2020-01-01T00:00:00Z"))
    assert again["WARC-Refers-To"] == said["WARC-Record-ID"] and none_ == b""
    none = (tmp_path / "n").as_uri()
    assert read_warc(write_warc(df.where("false"), none), none).count() == 0


def _labelled(spark, n=900, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("th", "er", "on", "re") for b in ("an", "in", "ou", "at", "es")]
    docs, labels, bad = [], [], set()
    for k in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        kind = rng.random()
        if kind < 0.15:
            t = [w + rng.choice(["$$$", "***", "###"]) for w in t]
        elif kind < 0.3:
            t[rng.randrange(len(t))] = rng.choice(["moron", "idiot", "scum"])
        if kind < 0.3:
            bad.add(k)
        docs.append((k, " ".join(t), "en", f"s{k % 5}", len(t), "x"))
        if k % 2 == 0:
            labels.append((k, 0 if kind < 0.15 else 1, int(0.15 <= kind < 0.3)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bad


def test_cotraining_on_held_out_documents(spark):
    docs, labels, bad = _labelled(spark)
    out = [r for r in quality_scores(docs, labels).collect() if r.doc_id % 2]
    right = sum(r.kept == (r.doc_id not in bad) for r in out)
    assert right >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_long_texts_are_hashed_by_segments(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(400)).encode(), b"x" * 5000 + b" y!\n" + b"z" * 9000, b"", b" \n"]
    whole = weighted_shingles(texts), features(texts, [("s",)] * 4)
    cut = lambda t, most=0: batches_segments(t, 700)
    monkeypatch.setattr(shingles, "segments", cut)
    monkeypatch.setattr(shingles, "TOGETHER", 700)
    monkeypatch.setattr(cotraining, "segments", cut)
    parts = weighted_shingles(texts), features(texts, [("s",)] * 4)
    assert all((a == b).all() for a, b in zip(whole[0], parts[0], strict=True))
    assert np.allclose(whole[1][2], parts[1][2]) and sorted(zip(*whole[1][:2])) == sorted(zip(*parts[1][:2]))
    assert b"".join(batches_segments(texts[0], 700)) == texts[0] and max(map(len, batches_segments(texts[0], 700))) < 720


def test_metadata_values_are_told_apart_whole():
    rows = [("news.example.com", "en"), ("blog.example.com", "en"), ("a-host.example", "news.example.com")]
    hashed = features([b"x"] * 3, rows)[3]
    assert hashed[0][0] != hashed[1][0] and hashed[0][1] == hashed[1][1]
    assert hashed[2][1] != hashed[0][0]  # the column counts for long values too


def test_labelled_documents_are_those_at_hand_and_count_once(spark):
    docs, labels, _ = _labelled(spark, 200)
    far = spark.range(1_000, 101_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert train(docs, labels.union(far), labelled=80, rounds=0) is not None
    texts = [(k, f"text {j}", "s", "en") for k in (1, 2) for j in range(50)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")
    ids = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, y double")
    chosen = [_chosen(r, ids, "doc_id", "text", ["source", "lang"]) for r in (rows, rows.orderBy("text"))]
    words = np.sort(features([b"text 0 1 2 3 4 5 6 7 8 9 10 11 12 13"], [()])[1])
    once, again = (_collect(c, words, "doc_id", "text", ["source", "lang"]) for c in chosen)
    assert once["id"].tolist() == [1, 2] and once["y"].tolist() == [1.0, 0.0]
    assert all((a == b).all() for a, b in zip(once["places"], again["places"], strict=True))


def test_tokens_are_counted_by_documents(spark, monkeypatch):
    texts = ["a a b", "a b c", "a b", "a", "a d d d d d d", "b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    of = lambda *w: sorted(int(features([x.encode()], [()])[1][0]) for x in w)
    assert _vocabulary(df, "text").tolist() == of("a")
    monkeypatch.setattr(cotraining, "LEAST_DOCS", 4)
    assert _vocabulary(df, "text").tolist() == of("a", "b")
    monkeypatch.setattr(cotraining, "WORDS", 1)
    assert _vocabulary(df, "text").tolist() == of("a")


def _two_views(spark, n=4000, seed=2):
    """Sources that tell the class in 19 of 20 documents, words of which each is in few, and 300 labels."""
    rng = random.Random(seed)
    docs, labels, bad = [], [], set()
    for k in range(n):
        wrong = rng.random() < 0.5
        source = rng.randrange(10) + 10 * (wrong != (rng.random() < 0.05))
        words = [f"{'evil' if wrong else 'good'}{rng.randrange(1500)}" for _ in range(5)] + [f"w{rng.randrange(300)}" for _ in range(25)]
        rng.shuffle(words)
        docs.append((k, " ".join(words), "en", f"s{source}"))
        bad |= {k} if wrong else set()
        if k < 300:
            labels.append((k, int(not wrong), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bad


def test_a_round_in_plain_python(spark):
    docs, labels, _ = _two_views(spark, 600)
    views = train(docs, labels, rounds=0)
    own = np.arange(300)
    text_odds, meta_odds, many = _taught(docs.repartition(3), views, own, "doc_id", "text", ["source", "lang"])
    counts = {v: [Counter(), Counter()] for v in ("text", "meta")}
    labelled = {"text": [0, 0], "meta": [0, 0]}
    for r in docs.collect():
        owner, h, numbers, hashed = features([r.text.encode()], [(r.source, r.lang)])
        p_text, p_meta, _ = (float(x[0]) for x in views.score(owner, h, numbers, hashed))
        at = {"text": [int(x) >> 64 - cotraining.TAUGHT_BITS for x in h], "meta": cotraining._meta_rows(hashed, numbers, views.edges)[0].tolist()}
        for pupil, teacher, other in (("text", p_meta, p_text), ("meta", p_text, p_meta)):
            side = 0 if teacher >= 0.9 and other >= 0.5 else 1 if teacher <= 0.1 and other < 0.5 else None
            if side is not None and r.doc_id not in own:
                counts[pupil][side].update(at[pupil])
                labelled[pupil][side] += 1
    assert many == {k: tuple(v) for k, v in labelled.items()} and sum(many["text"]) > 50
    for pupil, odds in (("text", text_odds), ("meta", meta_odds)):
        g, b = (np.array([counts[pupil][s][k] for k in range(len(odds))], float) for s in (0, 1))
        assert np.allclose(odds, log_odds(g, b))


def test_two_rounds_beat_none_where_views_can_teach(spark):
    docs, labels, bad = _two_views(spark)
    share = {}
    for rounds in (0, 2):
        out = [r for r in quality_scores(docs, labels, rounds=rounds).collect() if r.doc_id >= 300]
        share[rounds] = sum(r.kept == (r.doc_id not in bad) for r in out) / len(out)
    assert share[2] > share[0] + 0.01, share


def test_cotraining_without_labels_and_with_odd_rows(spark):
    docs, labels, _ = _labelled(spark, 200)
    out = quality_scores(docs, labels.where("false"))
    assert out.where("kept and score is null").count() == 200
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None, None), (7, "", None, "s", 0, "x")], docs.schema))
    got = quality_scores(odd, labels)
    assert got.count() == 202 and got.where("score is null").count() == 0
    assert quality_scores(docs.where("false"), labels).count() == 0


def _planted(spark, folder):
    """Documents with near copies, passages of 60 and of 40 words in several, nulls, empty texts and repeated doc_ids; the texts."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, short = text(60), text(40)
    rows = []
    for k in range(120):
        t = text(rng.randint(60, 120))
        if k % 10 == 1:
            t = f"{t} {passage} {text(20)}"
        if k % 10 == 2:
            t = f"{t} {short} {text(20)}"
        if k % 10 == 3:  # labelled bad
            t = " ".join(w + "$$$" for w in t.split())
        rows.append((k, t))
    rows += [(1000 + k, rows[k][1].replace(rows[k][1].split()[50], "other", 1)) for k in range(0, 40, 2)]  # near copies
    rows += [(2000, None), (2001, ""), (2002, " \n"), (7, rows[7][1]), (None, text(80))]
    table = [(k, t, "en", f"s{(k or 0) % 2}", len(t or "")) for k, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 10 != 3), 0) for k in range(0, 120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def _without_passages(texts, span, least):
    """Texts without maximal runs of repeated span-byte strings that hold least whole words."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        kept, i = b"", 0
        while i < len(r):
            j = i
            while j < len(r) and gone[j] == gone[i]:
                j += 1
            words = [m.span() for m in re.finditer(rb"\S+", r)]
            if not gone[i] or sum(i <= a and b <= j for a, b in words) < least:
                kept += r[i:j]
            i = j
        out.append(kept.decode("utf-8", "ignore"))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from tokenizers import Tokenizer

    _planted(spark, str(tmp_path))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == corpus_pipeline.COLUMNS
        state.write.parquet(str(tmp_path / name.split()[0]))
        state = spark.read.parquet(str(tmp_path / name.split()[0]))
        rows[name] = [(r.doc_id, r.text, r.source, r.n_chars) for r in state.collect()]
    quality, near, passages, mixed = rows.values()
    # 1: what is labelled bad goes, what is labelled good stays
    kept = {k for k, *_ in quality}
    assert all((k in kept) == (k % 10 != 3) for k in range(120))
    # 2: one of each class by brute force
    bags = [(k, _bag(t or "")) for k, t, *_ in quality if k is not None]
    ids = sorted({k for k, _ in bags})
    linked = [(a, b) for a, x in bags for b, y in bags if a < b and x and y and _jp(x, y) >= 0.8]
    want = _classes(ids, linked)
    assert Counter(k for k, *_ in near) == Counter(k for k, *_ in quality if k is None or want[k] == k)
    assert sum(a != b for a, b in linked) >= 15
    # 3: long passages go, short ones stay
    texts = [t for _, t, *_ in near]
    expected = _without_passages(texts, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
    assert sorted((k, e) for (k, *_), e in zip(near, expected) if k is not None) == sorted((k, t) for k, t, *_ in passages if k is not None)
    assert sum(e != (t or "") for e, t in zip(expected, texts)) >= 5
    assert all(n == len(t) for _, t, _, n in passages)
    # 4: whole copies and a first part of each document, as many words as each source is to give
    words = Counter()
    for _, t, source, _ in passages:
        words[source] += len(t.split())
    first, second = sorted(words)
    total = sum(words.values())
    target = {first: min(total / 3, 3 * words[first]), second: min(2 * total / 3, 3 * words[second])}
    target = {first: min(3 * words[first], total - target[second]), second: min(3 * words[second], total - target[first])}
    taken, of = Counter(), {}
    for k, t, *_ in passages:
        of.setdefault(k, set()).add(" ".join(t.split()))
    for k, t, source, _ in mixed:
        taken[source] += len(t.split())
        assert any(full.startswith(" ".join(t.split())) for full in of[k])
    assert all(abs(taken[s] - target[s]) <= 1 for s in words)
    # 5: the library's ids
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    final = corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path)).collect()
    want = Counter((k, tuple(lib.encode(t, add_special_tokens=False).ids)) for k, t, *_ in mixed)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in final) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in final)


def test_pipeline_of_nothing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_few_long_texts_are_signed_in_as_many_tasks_as_they_have_files(spark, tmp_path):
    """Tasks follow the width of the table, not the number of its rows: 160 texts of 230 KB in 16 files."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(str(x) for x in rng.integers(0, 10**6, 33_000))) for k in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        out = near_duplicates(spark.read.parquet(f"{tmp_path}/d"))
        assert out.where("kept").count() == 160
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    signed = max(Path(shared_dir(spark).removeprefix("file:")).rglob("minhash-signatures-*"), key=lambda p: p.stat().st_mtime)
    assert len(list(signed.glob("*.parquet"))) >= 16
