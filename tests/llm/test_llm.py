from __future__ import annotations

import base64
import os
import random
import sys
import time
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import CATALOG, EADV  # noqa: E402

from ruleframe.llm import encode, keyword_spam, mixing, terms, top_items  # noqa: E402
from ruleframe.llm import queries as llm_queries  # noqa: E402

VOCABULARY = Path(encode.TOKENIZERS) / encode.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no public vocabulary")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
T0 = datetime(2023, 1, 1)


# token ids


def small_vocabulary() -> bytes:
    """All bytes and a few merges, as ranks."""
    words = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaaa", b" a", b"the", b"th", b" the", "é".encode(), b"bca"]
    return b"\n".join(base64.b64encode(w) + b" " + str(i).encode() for i, w in enumerate(words))


def one_piece(rank: dict[bytes, int], piece: bytes) -> list[int]:
    """Merge the adjacent pair of the lowest rank, leftmost first, again and again."""
    if piece in rank:
        return [rank[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return [rank[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abc thé\n", max_size=60), st.text(max_size=20)), max_size=6))
def test_encoder_against_one_merge_at_a_time(texts):
    e = encode.Encoder(small_vocabulary())
    want = [[i for p in regex.findall(encode.PATTERN, t or "") for i in one_piece(e.rank, p.encode())] for t in texts]
    assert e.encode(texts) == want
    assert all(b"".join(e.bytes[i] for i in ids) == (t or "").encode() for ids, t in zip(e.encode(texts), texts))


def test_encoder_forgets_and_still_agrees(monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    e, f = encode.Encoder(small_vocabulary()), encode.Encoder(small_vocabulary())
    for text in ("ab cd ef gh ij kl", "abc the aaaa", "ab cd abc aaaaaaa", "x" * 5000 + "ab" * 3000):
        assert e.encode([text]) == f.encode([text])


@needs_vocabulary
def test_ids_against_the_reference_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(1)
    texts = [None, "", " ", "Hello world", "<|endoftext|> is text", "naïve café 日本語 한국어 हिन्दी \U0001f600", "a" * 5000, "don't  stop\r\n\t  now ", "﻿​\x00", "1234567890 3.14"]
    texts += ["".join(rng.choice("abc dEé日\n!1") for _ in range(rng.randrange(200))) for _ in range(60)]
    raw = VOCABULARY.read_bytes()
    own = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in encode.encode(df).collect()}
    assert got == {i: own.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    sized = {r.doc_id: r.tokens for r in encode.sizes(df, ["doc_id"]).collect()}
    assert sized == {i: len(x) for i, x in got.items()}
    assert encode.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        encode.MAX_BYTES, kept = 10, encode.MAX_BYTES
        try:
            encode.load(str(VOCABULARY))
        finally:
            encode.MAX_BYTES = kept


def test_decoding_gives_the_texts_back():
    e = encode.Encoder(small_vocabulary())
    for text in ("", "abc the é\n", "日本 \U0001f600 aaaa"):
        assert encode.decode_ids(e.bytes, e.encode([text])[0]) == text


# top items


def test_bins_never_fall_as_scores_rise(spark):
    rng = random.Random(2)
    xs = sorted({rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300) for _ in range(500)} | {rng.gauss(0, 5) for _ in range(500)} | {0.0, 1.0, 2.0, 4.0, 5e-324, -5e-324, float("inf"), float("-inf"), 1.9999999999999998})
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, float("nan")])], "i int, x double").withColumn("b", top_items.bin_of(F.col("x")))
    bins = [r.b for r in rows.orderBy("i").collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize(("worth", "most"), [(1, 1000), (1, 2), (8, 1000), (1 << 20, 1000)])
def test_top_against_brute_force(spark, monkeypatch, worth, most):
    monkeypatch.setattr(top_items, "WORTH", worth)
    monkeypatch.setattr(top_items, "EDGES", most)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice("ab"), rng.choice([None, 1.0, 2.0, 2.0, -1.0, 0.0, -0.0, rng.gauss(0, 1)]), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g long, h string, score double, t int").withColumn("__n", F.lit(1)).withColumn("__edge", F.lit("x"))
    df = df.drop("__n", "__edge").withColumn("extra", F.lit("kept"))
    got = {(r.g, r.h, r["rank"]): r.id for r in top_items.top(df, ["g", "h"], "score", 4, [F.desc_nulls_last("t"), F.asc("id")]).collect()}
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        mine = sorted((r for r in rows if (r[1], r[2]) == key and r[3] is not None), key=lambda r: (-r[3], -r[4], r[0]))
        want |= {(*key, k + 1): r[0] for k, r in enumerate(mine[:4])}
    assert got == want


def test_top_readings_cases(spark, catalog):
    rows = [(1, 1, "lab_k", T0, "5"), (2, 1, " LAB_K", T0 + timedelta(1), "5"), (3, 1, "lab_k", None, "5"), (4, 1, "lab_k", T0, "5.0"), (5, 1, "lab_k", T0, "4 mmol/L"), (6, 1, "lab_k", T0, None),
            (7, 1, "note", T0, "9"), (8, 1, "unlisted", T0, "9"), (9, None, "lab_k", T0, "1"), (10, 2, "enc_n", T0, "-1")]
    df = spark.createDataFrame([(*r, None, T0) for r in rows], EADV)
    assert {r.rid: r["rank"] for r in top_items.top_readings(df, catalog).collect()} == {2: 1, 1: 2, 4: 3, 9: 1, 10: 1}
    assert top_items.top_readings(df.limit(0), catalog).count() == 0


# terms


def text_rows(spark, rows):
    return spark.createDataFrame([(i, 1, a, T0, v, None, T0) for i, (a, v) in enumerate(rows)], EADV).withColumn("term", F.lit("clash"))


@pytest.mark.parametrize("max_bytes", [1, 1 << 30])
def test_terms_against_brute_force(spark, catalog, monkeypatch, max_bytes):
    monkeypatch.setattr(terms, "ALL_BITS", 14)
    monkeypatch.setattr(terms, "FOLD_BYTES", 4000)
    rng = random.Random(4)
    words = ["the", "The", "ÉTÉ", "été", "x1", "日本", "a_b", "don't", "हिन्दी"] + [f"w{i}" for i in range(200)]
    rows = [(rng.choice(["note", " NOTE ", "lab_k"]), rng.choice([None, "", "  ", "!!!", " ".join(rng.choices(words, k=rng.randrange(1, 30)))])) for _ in range(400)]
    rows += [("note", "long " * 20000)]
    cut = regex.compile(r"[\p{L}\p{Nd}]+").findall
    texts = [cut(v.lower()) for a, v in rows if a.strip().lower() == "note" and v]
    occurrences, records = Counter(t for ts in texts for t in ts), Counter(t for ts in texts for t in set(ts))
    holding = sum(bool(ts) for ts in texts)
    got = {r.term: r for r in terms.marked(text_rows(spark, rows), catalog, max_bytes=max_bytes).collect()}
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == {t: (occurrences[t], records[t]) for t in occurrences}
    assert all((r.rare, r.common) == (records[t] <= 2, records[t] * 4 > holding) for t, r in got.items())


def test_terms_of_one_long_text_and_a_folder_with_odd_marks(spark, catalog, tmp_path, monkeypatch):
    numbers = iter(range(9))
    monkeypatch.setattr(terms, "workspace", lambda spark, tag: f"file://{tmp_path}/a b%20'c/{tag}-{next(numbers)}")
    text = " ".join(f"w{i} w{i % 7}" for i in range(80_000))  # a megabyte
    terms.marked(text_rows(spark, [("note", "compiles the code")]), catalog).count()
    began = time.perf_counter()
    got = {r.term: (r.occurrences, r.records) for r in terms.marked(text_rows(spark, [("note", text), ("note", "w3")]), catalog).collect()}
    assert time.perf_counter() - began < 20 and len(got) == 80_000
    assert got["w3"] == (1 + 11429 + 1, 2) and got["w79999"] == (1, 1)


def test_terms_of_little(spark, catalog):
    both = text_rows(spark, [("note", "only"), ("note", "only")])
    assert {tuple(r) for r in terms.kinds(both, catalog).collect()} == {("note", "only", "rare"), ("note", "only", "common")}
    assert terms.kinds(text_rows(spark, [("note", "!"), ("note", None), (None, "x")]), catalog).count() == 0
    assert terms.kinds(both.limit(0), catalog).count() == 0


# mixtures


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.floats(0.05, 0.95), st.integers(0, 10_000))
def test_flight_keeps_both_totals(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 1000, n).astype(float)
    start = np.full(n, p)
    end = mixing.flight(start, x, rng)
    open_ = (end > 1e-9) & (end < 1 - 1e-9)
    assert open_.sum() <= 2
    assert end.sum() == pytest.approx(start.sum(), abs=1e-6) and (end * x).sum() == pytest.approx((start * x).sum(), rel=1e-6)
    landed = mixing.land(end, x)
    assert set(landed) <= {0.0, 1.0} and abs((landed * x).sum() - (start * x).sum()) <= 2000


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 10_000))
def test_exchanges_come_nearer_to_the_goal(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(4, 1.2, n)) + 1
    p = (rng.random(n) < 0.5).astype(float)
    goal = float((rng.random(n) < 0.5) @ x)
    end = mixing.exchange(p, x, goal)
    assert set(end) <= {0.0, 1.0} and abs(end @ x - goal) <= abs(p @ x - goal)
    if n >= 40:
        assert abs(end @ x - goal) <= max(1.0, 0.002 * x.sum())


def test_flight_is_unbiased():
    x = np.array([1.0, 2.0, 3.0, 10.0, 50.0, 7.0])
    mean = np.mean([mixing.flight(np.full(6, 0.4), x, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.all(np.abs(mean - 0.4) < 0.04)


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randrange(1, 60), source) for i, source in enumerate(["Big Board"] * 900 + ["small-board"] * 60 + [" mid_board "] * 300 + ["no_target"] * 50)]
    docs += [(2000, None, "big_board"), (2001, "", "small_board"), (2002, "text", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(1)).withColumn("copies", F.lit(9))
    targets = spark.createDataFrame([("big_board", 0.5, 1), ("small_board", 0.2, 4), ("mid_board", 0.2, 3), ("empty_board", 0.1, 2)], "source string, target_share double, max_repeats int")
    for chunk in (20_000, 40):
        used, plan = mixing.mix(df, targets, chunk=chunk)
        got = {r.doc_id: r for r in used.collect()}
        repeats = {"big_board": 1, "small_board": 4, "mid_board": 3}
        assert all(1 <= r.copies <= repeats[r.source] for r in got.values()) and not got.keys() & {2000, 2001, 2002}
        tokens = Counter()
        for r in got.values():
            tokens[r.source] += r.tokens * r.copies
        total = sum(tokens.values())
        want = {"big_board": 5 / 9, "small_board": 2 / 9, "mid_board": 2 / 9}
        assert {s: tokens[s] / total for s in want} == pytest.approx(want, rel=0.001)
        assert {r.doc_id: r.copies for r in mixing.mix(df, targets, chunk=chunk)[0].collect()} == {i: r.copies for i, r in got.items()}
    s = {r.source: r for r in mixing.shares(df, targets).collect()}
    assert (s["empty_board"].reached_share, s["empty_board"].tokens, s["empty_board"].target_share) == (0.0, 0, 0.1)
    assert sum(r.reached_share for r in s.values()) == pytest.approx(1) and s["small_board"].copies > s["small_board"].documents
    junk = targets.unionAll(spark.createDataFrame([(None, 0.5, 1), ("no_target", 0.0, 1), ("small_board", 0.3, 0), ("BIG-BOARD", float("nan"), 2)], targets.schema))
    assert {r.source: r.reached_share for r in mixing.shares(df, junk).collect()} == pytest.approx({k: r.reached_share for k, r in s.items()})
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[0].count() == 0


# keyword spam


def repeats_of(text, least):
    """Positions inside any run of at least ``least`` characters that occurs elsewhere too."""
    out = [False] * len(text)
    for i in range(len(text) - least + 1):
        if text.find(text[i : i + least]) < i or text.find(text[i : i + least], i + 1) >= 0:
            out[i : i + least] = [True] * least
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc d1", max_size=60), st.integers(2, 6))
def test_automaton_against_brute_force(text, least):
    twice, often = keyword_spam.again(text, least)
    assert twice.tolist() == repeats_of(text, least)
    cover, letters = keyword_spam.repeats(text, twice, least)
    assert cover == pytest.approx(sum(repeats_of(text, least)) / max(1, len(text)))
    runs = {text[a:b] for a in range(len(text)) for b in range(a + least, len(text) + 1)}
    times = {r: sum(text.startswith(r, k) for k in range(len(text))) for r in runs}
    assert letters == max((n * sum(map(str.isalpha, r)) for r, n in times.items() if n >= 4), default=0)
    want = {i for r, n in times.items() if len(r) == least and n >= 4 for k in range(len(text)) if text.startswith(r, k) for i in range(k, k + least)}
    assert set(np.flatnonzero(often)) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="oak sfa.\n", min_size=40, max_size=200))
def test_bounds_never_change_a_verdict(text):
    plain = keyword_spam.plain(keyword_spam.own_text(text))
    n = sum(map(str.isalpha, plain))
    twice, often = keyword_spam.again(plain)
    cover, letters = keyword_spam.repeats(plain, twice)
    phrase = min(letters, sum(plain[i].isalpha() for i in np.flatnonzero(often))) / max(1, n)
    assert keyword_spam.is_spam(n, cover, phrase, keyword_spam.outside(keyword_spam.own_text(text))) == keyword_spam.is_spam(*keyword_spam.measure(text))


def test_without_the_automaton_nothing_is_found(monkeypatch):
    monkeypatch.setattr(keyword_spam, "repeats", lambda text, kept: (0.0, 0))
    assert not any(keyword_spam.is_spam(*keyword_spam.measure(t)) for t in SPAM)


SPAM = [
    "cheap oak sofa | order oak sofa today | oak sofa free shipping | oak sofa Lowmere | top oak sofa 2020 | wholesale oak sofa | oak sofa price | oak sofa near me",
    "Our cat sat on the mat.\n\n" + "linen belt sale, linen belt red, buy linen belt online, linen belt Northgate, top linen belt, " * 4 + "\nThat is all I have.",
    "\n".join(f"http://shop{i}.example/item?id={i}" for i in range(12)),
    "\n".join(f"[url=http://a{i}.test/glass-kettle-{w}]glass kettle {w}[/url]" for i, w in enumerate(["price", "sale", "red", "blue", "online", "today", "best", "new"])),
    "#GlassKettle #glass_kettle_sale #GlassKettleRed #oak_sofa #OakSofa #oak_sofa_Lowmere #GlassKettle #oak_sofa #OakSofaBlue",
    "ｓｉｄｉｎｇ ｗａｌｌｅｔ ｃａｒ ｍａｔｓ ｓｉｄｉｎｇ ｗａｌｌｅｔ ｒｅｄ ｃａｒ ｍａｔｓ " * 3,
    "white (363) selvedge (290) ladder (150) heddle (51) olive (240) lowmere (243) shed (165) saddle (246) boots (366) filter (348) ostwick (203) reed (216) planter (210)",
    "Need carbon fence? Zendrum carbon fence has carbon fence, top carbon fence, new carbon fence. " * 4,
    "чай для похудения недорого Velno чай для похудения отзывы кредит онлайн доставка кредит онлайн лучшие чай для похудения доставка кредит онлайн отзывы",
    "o a k  s o f a  s a l e  " * 8,
    "[quote=someone]I really like how the pump is holding up after the repair.[/quote]\n" + "pump seal price; pump seal sale; pump seal Lowmere; cheap pump seal; " * 4,
]
HAM = [
    None, "", "   ", "ok thanks", "graft, mulch, aphid — your turn!", "[removed]",
    "The gasket held up surprisingly well, which is why I stopped. Where do you buy parts these days, is there a cheap shop near me or only online? The best price I found was 34, free shipping included.",
    "Here is what I bought for the rebuild, in case it helps the next person:\n- bent bobbin, 65 mm\n- heavy sett, 54 mm\n- crooked yarn, 72 mm\nThe old warp had been painted over twice, so I was glad that it all arrived on time and that nothing was broken.",
    "> cheap oak sofa | order oak sofa today | oak sofa free shipping | oak sofa Lowmere | top oak sofa 2020\n> wholesale oak sofa | oak sofa price | oak sofa near me\nNot this again. Can somebody please remove this and ban the user? It is the third time this week.",
    "Hello friends, I would like to tell you about Zendrum, a small shop that changed how I look after my things. They sell garden hoses, and the parcel arrived two days earlier than promised. You can read more on their page.",
    "조립하기 전에 뚜껑을 조심해서 열었는데 사진은 나중에 올릴게요. 다행히 소리가 꽤 줄었고 아직 마음에 들지 않습니다. 어제 저녁에 물이 뒤쪽으로 새어 나왔고 꽤 놀랐습니다.",
    "Прошлой зимой прокладка совсем высохла. Есть идеи? Вчера прокладка совсем высохла. Снимки будут позже. К счастью, вода пошла с другой стороны, потому что я спешил.",
    "昨日、古い紐を新しいものに替えました。写真は後で載せます。今日は天気が良かったので、外で作業しました。部品はまだ届いていません。",
    "The shaft turned freely after I cleaned it.\n-- \nMy builds: http://a.example/one | http://b.example/two | http://c.test/three | http://d.test/four | http://e.test/five | http://f.test/six",
    "[code]\n11:13:51 WARN bobbin=29 retry\n21:08:53 WARN selvedge=3 retry\n[/code]\nThis is what the controller printed when I switched it on yesterday; does anybody know what it means?",
]


def test_spam_and_ham(spark):
    assert [keyword_spam.is_spam(*keyword_spam.measure(t)) for t in SPAM] == [True] * len(SPAM)
    assert [keyword_spam.is_spam(*keyword_spam.measure(t)) for t in HAM] == [False] * len(HAM)
    df = spark.createDataFrame(list(enumerate(SPAM + HAM + [SPAM[0]])), "doc_id long, text string").withColumn("spam", F.lit("clash"))
    assert sorted(r.doc_id for r in keyword_spam.found(df).collect()) == [*range(len(SPAM)), len(SPAM + HAM)]
    assert keyword_spam.scores(df.limit(0)).count() == 0


def test_code_blocks_without_end_take_no_own_words():
    quote = "| [code]\n| 18:53:07 WARN bearing=43 retry\n| 22:15:34 WARN float=\n\n"
    log = "11:13:51 WARN bobbin=29 retry\n21:08:53 WARN sel\n"
    words = lambda t: keyword_spam.own_text(t).split()
    assert words("On 8 Dec, a_b wrote:\n" + quote + SPAM[0]) == SPAM[0].split()
    assert words(quote.replace("|", "&gt;") + "Mine is\n[code]\n> a prompt\n" + log + "[/code]\nnew.") == ["Mine", "is", "new."]
    for start in ("[code]", "```", "<pre>"):
        assert words(f"{start}\n{log}Mine is new.") == ["Mine", "is", "new."]
        assert words(f"Mine {start}x = 5\n> {start}\n> b\nis new.") == ["Mine", "is", "new."]
        assert [keyword_spam.is_spam(*keyword_spam.measure(t)) for t in (quote + SPAM[0], f"{start}\n{SPAM[2]}", f"It printed this on its own.\n{start}\n" + log * 5)] == [True, True, False]


def test_phrases_without_spaces_are_repeats():
    spam = lambda t: keyword_spam.is_spam(*keyword_spam.measure(t))
    phrases = ("便宜沙发网上购买", "格安ソファ通販", "โซฟาราคาถูก")
    assert [spam(p * 100) for p in phrases] == [True] * 3
    assert [spam(p) for p in phrases] == [False] * 3
    assert not spam("昨天我把旧的垫圈换掉了，声音小了很多，但是水还是从后面漏出来。")
    assert not spam("เมื่อวานฉันเปลี่ยนปะเก็นเก่าแล้วเสียงเบาลงมาก")


def test_a_very_long_page_is_measured_whole():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=6))
    story = "".join(f"The {word()} was not as {word()} as we had {word()}, but it {word()} on my {word()}. " for _ in range(2000))
    assert not keyword_spam.is_spam(*keyword_spam.measure(story))
    assert keyword_spam.is_spam(*keyword_spam.measure(story[:500] + "oak sofa sale, oak sofa red, cheap oak sofa, " * 4000))
    assert not keyword_spam.is_spam(*keyword_spam.measure(story + "oak sofa sale, oak sofa red, cheap oak sofa, " * 20))


# queries


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(set(llm_queries.SQL) - {"p8_met"}))  # boards of three documents cannot meet a share
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("eadv", "att_catalog", "documents", "mix_targets"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = llm_queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(llm_queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())


@pytest.mark.skipif(not Path(FOLDER).with_name("sf0.01").exists() or not VOCABULARY.exists(), reason="no driver tables")
@pytest.mark.parametrize("seed", [7, 8, 9])
def test_shares_are_met_on_the_given_tables(spark, seed):
    folder = Path(FOLDER).with_name("sf0.01")
    rows = mixing.met(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/mix_targets.parquet"), seed).collect()
    assert sum(r.met for r in rows) >= 9 and all(r.met == (r.goal is not None) and r.kept for r in rows)


@pytest.mark.skipif(not Path(FOLDER).exists() or not VOCABULARY.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["p7_ids", "p8_mix", "p8_shares", "p9_found", "p9_scores"])
def test_runs(spark, name):
    assert llm_queries.QUERIES[name](spark, FOLDER).count() > 0


def test_catalogue_fixture(catalog):
    assert catalog.schema.simpleString() == catalog.sparkSession.createDataFrame([], CATALOG).schema.simpleString()
