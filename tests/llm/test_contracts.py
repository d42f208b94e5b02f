"""Language identification, mixing, sharding, WARC, chat and the pipeline against brute force on small fixtures."""

import base64
import hashlib
import random
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandlake.llm import chat, langid, mixing, sharding, warc

WORDS = {"aa": "tal mora selin kedo paru", "bb": "xhuq wyrt zhkol bryzk fluhm", "cc": "eoa iua oei aiou uoe"}


def sentence(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "n"]) for _ in range(n))


def test_language_identification_on_held_out_rows(spark):
    rows = [(i, sentence(lang, i), lang) for i, lang in enumerate([x for x in WORDS for _ in range(40)])]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "aa"), (None, sentence("cc", "x"), None)], "doc_id long, text string, lang string")
    model = langid.train(df, df.doc_id % 3 != 1)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 3 == 1]
    assert all(got[i].lang_pred == lang for i, lang in held) and got[None].lang_pred == "cc"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(df.limit(0), df.doc_id % 3 != 1) is None and langid.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


@pytest.mark.parametrize("chars", [62, 63, 64, 65])
def test_a_long_text_counts_as_it_would_in_one_piece(monkeypatch, chars):
    texts = [sentence("aa", 1, 400), "\U00010400b c" * 50, "", None, "x" * 333, "\u0130" * 64 + " tail", "ab " * 43]
    letters = langid._letters()
    monkeypatch.setattr(langid, "CHARS", 10**9)
    whole = np.concatenate(list(langid.features(texts, letters)))
    monkeypatch.setattr(langid, "CHARS", chars)
    assert (np.concatenate(list(langid.features(texts, letters))) == whole).all()


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9):
        code = langid.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= max(1, code.shape[1] // 4)


@pytest.mark.parametrize("slots", [{"a": 1, "b": 1}, {"a": 512, "b": 341, "c": 170, "": 1}, {"a": 7}, {str(i): i + 1 for i in range(20)}])
def test_pfair_keeps_every_window_and_deviates_by_less_than_one_block(slots):
    plan, period, ran = mixing.pfair(slots), sum(slots.values()), dict.fromkeys(slots, 0)
    for t, (s, j, release, deadline, slot) in enumerate(plan):
        assert slot == t and release <= t < deadline and j == ran[s]
        ran[s] += 1
        assert all(abs(ran[x] - (t + 1) * a / period) < 1 for x, a in slots.items())
    assert ran == slots


def test_mixing_equals_a_plain_schedule(spark):
    rng = random.Random(3)
    docs = [(i, "é" * rng.randrange(60), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(400)] + [(None, None, "b"), (7, "again", "hot"), (7, "again", "hot")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "777 as _j", "'x' as position_", "'keep' as _size", "1 as block")
    weights, period, block = {"hot": 1.0, "b": 2.0, "": 1.0}, 16, 200
    got = sorted(mixing.mix(df, weights, block_bytes=block, period=period).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(docs)))
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(str, docs))
    slot = {(s, j): (r, d, t) for s, j, r, d, t in mixing.pfair(mixing.shares(weights, period))}
    per, want = mixing.shares(weights, period), []
    for s in per:
        own = sorted((x for x in docs if (x[2] or "") == s), key=lambda x: (hashlib.md5(str("" if x[0] is None else x[0]).encode()).hexdigest(), len((x[1] or "").encode())))
        start = 0
        for doc_id, body, _ in own:
            k, j = divmod(start // block, per[s])
            want.append((k * period + slot[s, j][2], start, doc_id, start // block))
            start += len((body or "").encode()) + 1
    want.sort(key=lambda x: x[:2])
    assert [(r.mix_slot, r.doc_id, r.block) for r in got] == [(t, d, b) for t, _, d, b in want]
    assert {(r._j, r._size, r.position_) for r in got} == {(777, "keep", "x")}
    assert mixing.mix(df.limit(0)).count() == 0


def test_shards_are_near_equal_and_keep_groups(spark):
    rng = random.Random(4)
    texts = [f"t{i} " + "w " * rng.randrange(200) for i in range(600)]
    docs = [(i, rng.choice(texts), rng.choice("xyz"), rng.choice(["aa", None])) for i in range(2000)] + [(None, None, None, None), (5000, "", "x", "aa")] + [(6000 + i, "hot group", "x", "aa") for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as shard", "2 as w")
    got = sharding.shard(df, 16).collect()
    sizes = {i: 0 for i in range(16)}
    for r in got:
        sizes[r.shard] += r.size
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in docs)
    assert max(sizes.values()) < 1.25 * sum(sizes.values()) / 16
    for shard, rows in groupby(sorted((r.shard, r.slot) for r in got), key=lambda x: x[0]):
        assert [s for _, s in rows] == list(range(sum(r.shard == shard for r in got)))
    text_of, where = {d: t for d, t, _, _ in docs}, {}
    for r in got:
        where.setdefault(text_of[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if t != "hot group")
    assert {r.law for r in got} == {"bytes"} and sharding.shard(df.limit(0)).count() == 0


def test_warc_round_trip_in_tiny_ranges(spark, tmp_path):
    trap = "\x1f\x08" + warc.record("response", 77, "u", "X", 3, b"abc").decode("latin-1")
    pages = [(1, "http://a/é b", "<p>one</p>"), (2, None, None), (3, "http://c", ""), (4, "http://d", "<p>one</p>"), (5, "x\r\ny", trap), (None, "n", "alone"), (9, "n", "<p>one</p>"), (10, "big" * 500_000, "Ω line\r\n\r\n" * 90_000), (11, "z", trap)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as n", "2 as hex")
    manifest = warc.write_warc(df, f"file://{tmp_path}/w")
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    want = set()
    for p, _, h in pages:
        body = (h or "").encode()
        other = last[h or ""] if last[h or ""] not in (p, -1) else None
        want.add((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if other is None else "revisit", other))
    for split in (7, 100, 4 << 20):
        got = warc.read_warc(manifest, split, payloads=True).collect()
        assert len(got) == len(pages)
        assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
        assert all(bytes(r.payload) == (dict((p, h) for p, _, h in pages)[r.page_id] or "").encode() for r in got if r.record_type == "response")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chat_snapshots_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[(rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok", "", None])) for _ in range(9)] for _ in range(4)]
    convs = {i: (b := rng.choice(base))[: rng.randrange(1, len(b) + 1)] for i in range(60)}
    rows = [(c, t, r, x) for c, said in convs.items() for t, (r, x) in enumerate(said)]
    got = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    keep = {c for c, said in convs.items() if not any(o != c and other[: len(said)] == said and (len(other) > len(said) or o < c) for o, other in convs.items())}
    assert {r.conv_id for r in got} == keep
    for c in keep:
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.pos)
        assert [r.rendered for r in mine] == [f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n" for role, text in convs[c]]
    forged = chat.chat_format(spark.createDataFrame([(1, 1, "user", "a<|im_end|>b")], "conv_id long, turn long, role string, text string"), escaped="?").first()
    assert forged.rendered == "<|im_start|>user\na?b<|im_end|>\n"
    assert len({(r.conv_id, r.n_collapsed) for r in got}) == len(keep) and len(keep) + sum({r.conv_id: r.n_collapsed for r in got}.values()) == len(convs)


def test_pipeline_on_planted_documents(spark, tmp_path):
    item = " ".join(f"quiz{i} {WORDS['aa']}" for i in range(12))
    long = {i: " ".join(f"{sentence('aa', (i, j), 6)} u{i}x{j}" for j in range(12)) for i in range(30)}
    docs = [(i, t, "aa", "hot" if i % 3 else "b") for i, t in long.items()] + [(100 + i, sentence("bb", i, 80) + f" {i}", "bb", "b") for i in range(30)]
    planted = [(200, long[3] + " tail", "aa", "b"), (201, long[3], "aa", "hot"), (202, "intro here " + item + " outro there", "aa", "b"), (203, None, "aa", "b"), (204, "123 456", "bb", None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs + planted, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, *_ in docs)
    assert {(r.doc_id, r.text, r.source) for r in got} == {(d, t, s) for d, t, _, s in docs}
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_pipeline_keeps_unique_texts_and_one_row_of_copies(spark, tmp_path):
    a, b = (sentence("aa", ("u", i), 60) for i in range(2))
    docs = [(1, a, "aa", "s", 0.5), (5, a, "aa", "s", 0.5), (5, b, "aa", "s", 0.5), (5, b, "aa", "s", 0.5), (None, b + " x", "aa", "s", 0.5), (None, sentence("bb", 9, 60), "bb", "s", 0.5), (None, sentence("bb", 9, 60), "bb", "s", 0.5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double").selectExpr("*", "1 as a", "2 as row", "3 as lang_pred")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", a), ("5", b), ("None", sentence("bb", 9, 60))])
    assert corpus_pipeline.language(spark, df, "").columns == df.columns
    unlearned = df.withColumn("lang", df.lang.substr(0, 0)).where("false").unionByName(df.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "score", "a", "row", "lang_pred"))
    assert corpus_pipeline.language(spark, unlearned, "").count() == len(docs)


def test_pipeline_shards_follow_the_mixing_schedule(spark, tmp_path):
    docs = [(i, sentence("aa" if i % 2 else "bb", ("m", i), 60) + f" {i}", "aa" if i % 2 else "bb", "hot" if i % 5 else "rare") for i in range(160)]
    folder = str(tmp_path / "sf")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) > 100
    kept = df.where(df.doc_id.isin([r.doc_id for r in got]))
    position = {r.doc_id: r.position for r in mixing.mix(kept).collect()}
    for shard in range(corpus_pipeline.SHARDS):
        rows = sorted((r.slot, position[r.doc_id]) for r in got if r.shard == shard)
        assert [s for s, _ in rows] == list(range(len(rows))) and [p for _, p in rows] == sorted(p for _, p in rows)


def test_pipeline_sends_small_batches_and_mixes_without_python_workers(spark):
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "concat('word ', id) as text", "if(id % 3 = 0, 'a', 'b') as source", "cast(null as string) as lang")
    plan = corpus_pipeline.mix(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("ExistingRDD", "Python", "Arrow"))
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.select("doc_id")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert corpus_pipeline.language(spark, docs, "").count() == 2500
        sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect()]
        assert sum(sizes) == 2500 and max(sizes) <= 1000
        spark.conf.set(key, "100")
        corpus_pipeline.language(spark, docs, "")
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
