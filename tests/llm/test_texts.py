"""Text operators against brute force and the tokenizers library, with the odd cases."""

import json
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from twinlake.llm import simple8b, suffix_dedup  # noqa: E402
from twinlake.llm.bpe import Vocabulary, read_vocabulary  # noqa: E402
from twinlake.llm.chunk_bpe import ChunkEncoder, decode_ids, encode_texts  # noqa: E402
from twinlake.llm.host_quality import beta_priors, host_quality  # noqa: E402
from twinlake.llm.source_mix import mix_sources, source_targets  # noqa: E402
from twinlake.llm.suffix_blocks import repeated  # noqa: E402
from twinlake.llm.suffix_dedup import _whole_words, remove_repeats, repeated_intervals  # noqa: E402
from twinlake.llm.token_files import read_token_files, write_token_files  # noqa: E402
from twinlake.llm.token_prefixes import PrefixCounts, chars_within, count_prefixes, tokens_of_prefix  # noqa: E402
from twinlake.session import shared_dir  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
VOCAB = Vocabulary(read_vocabulary(PATH))
ODD = [
    "", "a", "don't we'll  they've   it'd\n\n\n x", "a  b   c \n d\t\te", "  lead", "trail   ", "é è ñandú   ß",
    "!!<|endoftext|>abc  <|endoftext|><|endo<|endoftext|>", "<|endoftext|>", "12345 67,89  $$$ ###", "x" * 3000,
    " " * 1500 + "a", "你好 世界\U0001f600 ok՘z", "a\x1c\x1d\x85\xa0 b", "'ll'll ''ll 're' l", "\r\n\r\n a",
    "ab " * 2000, "É" * 500 + " \n" * 100,
]


def _ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


def _docs(spark, rows, schema="doc_id long, text string, source string, ids string, kept string, n_tokens string"):
    return spark.createDataFrame([(k, t, f"s{k % 2}" if k else None, "x", "y", "z") for k, t in rows], schema)


def test_chunks_encode_as_the_library():
    rng = random.Random(2)
    parts = ["ab", "'s", "\n", "  ", " ", "é", "<|endoftext|>", "1", ".,!", "lre", " the"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.choice([10, 500, 3000]))) for _ in range(60)]
    for got, t in zip(ChunkEncoder(VOCAB).encode(texts), texts, strict=True):
        assert got.tolist() == _ids(t)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_any_text_encodes_as_the_library(text):
    assert VOCAB.encode(text).tolist() == _ids(text)
    assert VOCAB.decode(VOCAB.encode(text)).decode() == text


def test_another_order_of_merges_goes_to_the_library():
    assert VOCAB.by_rank
    said = json.loads(read_vocabulary(PATH))
    m = said["model"]["merges"]
    m[0], m[1] = m[1], m[0]
    other = Vocabulary(json.dumps(said))
    assert not other.by_rank
    lib = Tokenizer.from_str(json.dumps(said))
    for t in ODD:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert other.encode(t).tolist() == ids
        assert other.decode(other.encode(t)).decode() == lib.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        PrefixCounts(other)


def test_every_prefix_is_counted_exactly():
    counter = PrefixCounts(VOCAB)
    rng = random.Random(1)
    texts = [t[:120] for t in ODD] + ["".join(rng.choice("ab'slre \n\té<|endoftext|>1.,!") for _ in range(50)) for _ in range(60)]
    for t, got in zip(texts, counter.of(texts), strict=True):
        assert got.tolist() == [len(_ids(t[:k])) for k in range(1, len(t) + 1)], repr(t)


def test_count_and_encode_frames(spark):
    rows = list(enumerate(ODD)) + [(99, None), (1, "a"), (1, "a")]
    df = _docs(spark, rows)
    want = Counter((k, len(_ids(t or ""))) for k, t in rows)
    out = count_prefixes(df, PATH, limits=(2, 1024), table=True)
    assert out.columns.count("n_tokens") == 1
    got = out.collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    for r in got:
        t = r.text or ""
        counts = np.frombuffer(r.prefix_counts, "<u4")
        assert len(counts) == len(t)
        assert r.cuts[0] == max((k + 1 for k, c in enumerate(counts) if c <= 2), default=0)
    out = decode_ids(encode_texts(df, PATH), PATH).collect()
    for r in out:
        t = r.text or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == _ids(t) and r.decoded == t
    none = df.where("false")
    assert count_prefixes(none, PATH).count() == encode_texts(none, PATH, decoded="d").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, escaped = simple8b.pack(v)
    assert (simple8b.unpack(words, escaped) == v).all()
    assert len(words) <= len(v)


def test_token_files_round_trip(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "tie"), (None, "no id"), (7, None), (50, "word " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    uri = (tmp_path / "t").as_uri()
    files = write_token_files(df, PATH, uri, end_id=0)
    got = sorted(read_token_files(files, uri).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (k, t) in zip(got, rows, strict=True):
        ids = _ids(t or "") + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (k, start, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    none = write_token_files(df.where("false"), PATH, (tmp_path / "n").as_uri())
    assert read_token_files(none, (tmp_path / "n").as_uri()).count() == 0


def _intervals(texts, span):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        merged = []
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = i + span
                else:
                    merged.append([i, i + span])
        out.append(merged)
    return out


def test_questions_to_a_stored_table_of_prefixes(spark, tmp_path):
    """Truncations and budgets, one a row, from counts that were written; nothing is encoded again."""
    texts = [*(t[:400] for t in ODD), None]
    df = spark.createDataFrame([(k, t, (7 * k) % 23 - 1) for k, t in enumerate(texts)], "doc_id long, text string, ask int")
    count_prefixes(df, PATH, table=True).drop("text").write.parquet(f"{tmp_path}/prefixes")
    stored = spark.read.parquet(f"{tmp_path}/prefixes")
    ask = F.col("ask")
    rows = stored.select("doc_id", "ask", tokens_of_prefix(F.col("prefix_counts"), ask).alias("tokens"), chars_within(F.col("prefix_counts"), ask).alias("chars")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.tokens == len(_ids(t[: max(r.ask, 0)])), r
        assert r.chars == max((k for k in range(1, len(t) + 1) if len(_ids(t[:k])) <= r.ask), default=0), r
    none = stored.select(tokens_of_prefix(F.lit(None).cast("binary"), ask).alias("a"), chars_within(F.lit(None).cast("binary"), ask).alias("b")).first()
    assert none.a is None and none.b is None


@pytest.mark.parametrize("letters", [2, 3, 20])
def test_repeated_windows_by_cover_ranks(letters):
    rng = np.random.default_rng(letters)
    base = rng.integers(97, 97 + letters, 400).astype(np.uint8).tobytes()
    raw = b"".join(base[a : a + n] for a, n in zip(rng.integers(0, 300, 40), rng.integers(64, 100, 40)))
    text, starts = np.frombuffer(raw, np.uint8), np.arange(len(raw) - 63)
    seen = Counter(raw[i : i + 64] for i in starts)
    assert (repeated(text, starts, 64) == np.array([seen[raw[i : i + 64]] > 1 for i in starts])).all()


def test_repeats_go_and_nothing_else(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(120), text(60)
    texts = [text(80) + passage + text(30), passage, text(50) + passage[:700] + text(200), passage[:399], "", None]
    texts += [line + text(40) + line, "é" * 500, "x" * 2000, text(300), "twin " * 100, "twin " * 100]
    rows = list(enumerate(texts))
    df = _docs(spark, rows)
    raw = [(t or "").encode() for t in texts]
    want = _intervals(raw, 400)
    got = {}
    for r in remove_repeats(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(raw):
        r = got[k][0]
        assert [[s.low, s.high] for s in r.removed_spans] == want[k], k
        cut = b"".join(t[a:b] for a, b in zip([0, *(s[1] for s in want[k])], [*(s[0] for s in want[k]), len(t)]))
        assert bytes(r.kept) == cut
    whole = {r.doc_id: r.kept for r in remove_repeats(df, as_text=True).collect()}
    assert all(whole[k] == bytes(got[k][0].kept).decode("utf-8", "ignore") for k in whole)
    # buckets that are dealt again give the same
    docs = df.selectExpr("unhex(md5(text)) AS doc", "encode(text, 'UTF-8') AS raw").where("octet_length(raw) >= 400").distinct()
    cover = lambda n: {(bytes(r.doc), i) for r in repeated_intervals(docs, 400, bucket_contexts=n).collect() for i in range(r.low, r.high)}
    assert cover(2048) == cover(3) == cover(1)
    assert remove_repeats(df.where("false")).count() == 0


def test_passages_of_few_words_stay(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    few, many = text(50), text(51)
    texts = [f"{text(30)} X{few}X {text(9)}", f"{text(30)} Y{few} {text(9)}", f"{text(30)} {many} Q{text(9)}", f"P{many[:-1]}{many[-1]}"]
    texts += [f"{text(40)} {many} {text(9)}"]
    got = {r.doc_id: r for r in remove_repeats(_docs(spark, list(enumerate(texts))), 200, as_text=True, least_words=51).collect()}
    assert got[0].kept == texts[0] and got[1].kept == texts[1]  # 50 words, and those at the ends cut
    assert many not in got[2].kept and many not in got[4].kept and got[2].kept.startswith(texts[2][:150])
    assert _whole_words(b"ab cd ef", 0, 8) == 3 and _whole_words(b"ab cd ef", 1, 7) == 1 and _whole_words(b"ab cd ef", 3, 5) == 1
    assert _whole_words(b"ab cd ef", 2, 6) == 1


def test_copies_of_a_text_give_its_contexts_once(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(n))
    passage = text(120)
    texts = [text(60) + passage + text(60)] * 50 + [text(60) + passage + text(60), text(200)]
    seen, sort = [], suffix_dedup._sort_blocks
    monkeypatch.setattr(suffix_dedup, "_sort_blocks", lambda contexts, *a: seen.append(contexts) or sort(contexts, *a))
    got = {r.doc_id: r for r in remove_repeats(_docs(spark, list(enumerate(texts)))).collect()}
    want = _intervals([t.encode() for t in texts], 400)
    assert all([[s.low, s.high] for s in got[k].removed_spans] == want[k] for k in got)
    rows = seen[0].groupBy("bucket", "ctx").count().collect()
    assert len(rows) > 1 and all(r["count"] == 1 for r in rows)


def test_mix_meets_its_budgets(spark):
    rng = random.Random(0)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", None])) for k in range(300)]
    rows += [(500, None, "empty"), (501, "", "empty"), (1, "one two", "b"), (1, "one two", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [0, r.source_size, r.target, 0])
        s[0], s[3] = s[0] + r.taken, s[3] + r.size
    for taken, size, target, own in by.values():
        assert taken == int(target) and size == own and target <= 3 * size
    assert abs(sum(s[2] for s in by.values()) - sum(s[1] for s in by.values())) < 1e-6
    again = mix_sources(df.repartition(7), digits=2).collect()
    assert Counter(again) == Counter(got)
    assert mix_sources(df.where("false")).count() == 0


def test_copies_of_a_row_are_told_apart_in_many_tasks(spark, monkeypatch):
    """A third of all rows are equal: they go into the windows as one row a part of the table, and each gets its share."""
    rows = [(k, "a b c d", "s") for k in range(600)] + [(7, "one two three", "s")] * 400 + [(None, "x y", "t")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mix_sources(df, weights=(1, 1)).collect()
    total = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        total[r.source] += r.taken
    assert len(got) == 1200 and total == {"s": 3600 - 1200 + 400, "t": 1200}
    part = sum(0 < r.taken < r.size for r in got)
    assert part <= 1  # one row of all is cut
    tables = [p for p in Path(shared_dir(spark).removeprefix("file:")).glob("mix-groups-*")]
    newest = max(tables, key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(f"file:{newest}").where("n > 1").count() >= 8


def test_targets_share_what_caps_leave(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 10), ("c", 20)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got == {"a": 840.0, "b": 30.0, "c": 60.0}


def _rules(t):
    w = t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    w = [x for x in w if x]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a b", "a b c d e " * 9, "x\ny\nx\n\n \nx", "# $5 <b>|é\x0bü", "one two three four five six seven eight nine ten\xa0"]
    texts += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(20)] + [" ".join(map(str, range(50)))] * 2
    df = spark.createDataFrame([(k, t, "h" if k % 3 else None, "c") for k, t in enumerate(texts)], "doc_id long, text string, source string, kept string")
    for r in host_quality(df).collect():
        want = _rules(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert host_quality(df.where("false")).count() == 0


def test_priors_leave_chance_out(spark):
    """Rates of hosts drawn from a beta distribution, most of them with one to three pages."""
    rng = np.random.default_rng(9)
    for a, b in ((2.0, 6.0), (0.3, 0.9)):
        n = rng.integers(1, 4, 20_000)
        rate = rng.beta(a, b, len(n))
        k = rng.binomial(n, rate)
        hosts = spark.createDataFrame([(int(x), int(y), 0) for x, y in zip(n, k)], "n long, bad long, never long")
        got = beta_priors(hosts, ["bad", "never"])
        assert abs(got["bad"][0] - a / (a + b)) < 0.01 and 0.8 < got["bad"][1] / (a + b) < 1.25
        assert got["never"] == (0.0, 1e6)
    same = spark.createDataFrame([(50, 10, 0)] * 40, "n long, bad long, never long")
    assert beta_priors(same, ["bad"])["bad"] == (0.2, 1e6)
    assert beta_priors(same.where("false"), ["bad"])["bad"] == (0.0, 1e6)


def test_a_host_is_rejected_by_any_rule(spark):
    good = [" ".join(f"w{k * 31 + j}" for j in range(40)) for k in range(400)]
    rows = [(k, t, f"h{k % 20}") for k, t in enumerate(good)]
    rows += [(1000 + k, t.replace(" ", " # "), "signs.example") for k, t in enumerate(good[:60])] + [(2000, good[0], "signs.example")]
    rows += [(3000 + k, "Next\n" * 4 + t, "lines.example") for k, t in enumerate(good[:60])]
    out = {r.doc_id: r for r in host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[k].kept for k in range(400))
    assert not out[2000].base_failed and not out[2000].kept and out[2000].host_rate > 0.5
    assert not any(out[3000 + k].kept or out[3000 + k].base_failed for k in range(60))


def test_a_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(k, good if k % 50 == 0 else "bad", "bad.example") for k in range(200)]
    rows += [(1000 + k, good, f"h{k % 20}") for k in range(400)] + [(5000, "bad", "rare"), (5001, good, "rare")]
    out = host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {1000 + k for k in range(400)} | {5001}
