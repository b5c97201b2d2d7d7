"""Each operator on odd rows, and against a plain version of itself."""

import functools
import hashlib
import importlib.util
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomgraph.llm import chat, decontam, fingerprints, langid, licenses, linededup, mixing, neardup, quality, textvec, tokens
from loomgraph.operators.components import components

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def odd_rows():
    base = prose(1, 300)
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, base, None, "a", 1),
        (4, base, "en", "a", None),
        (5, base + " more", "en", "b", 1),
        (5, base + " more", "en", "b", 1),
        (None, base, "en", "b", 1),
        (6, "\n\n  \n", "en", "b", 1),
        (7, "x" * 70_000, "en", None, 1),
        (8, "Ünïcödé 😀 " * 20, "fr", "b", 1),
        (9, "one two", "de", "c", 1),
        (10, "one two", "de", "c", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Text vectors


@given(st.lists(st.text(alphabet="aBc \t\n\x0b.é😀", max_size=30), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_split_as_the_pattern_does(given_texts):
    data, offsets = textvec.texts(pa.array(given_texts, pa.string()))
    names, first, _ = textvec.words(data, offsets)
    own = [[w.decode() for w in t.encode().lower().split()] for t in given_texts]
    assert [int(n) for n in np.diff(first)] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in given_texts]
    by_name = defaultdict(set)
    for n, w in zip(names.tolist(), [w for ws in own for w in ws], strict=True):
        by_name[n].add(w)
    assert all(len(v) == 1 for v in by_name.values()) and len(by_name) == len({w for ws in own for w in ws})


def test_slices_cover_all_rows():
    offsets = np.cumsum([0, 5, 0, 100, 3, 3])
    assert [x for a, b in textvec.slices(offsets, 6) for x in range(a, b)] == list(range(5))


# 1


def plain_turns(rows):
    out = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: tuple((v is not None, v) for v in (r[0], r[1], r[2] or "", r[3] or ""))):
        out[c].append((r or "", x or ""))
    return out


def check_chat(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, **how)
    back = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    want = plain_turns(rows)
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        assert back[c]["targets"] == "".join(x for r, x in turns if r == "assistant")
    return windows


def test_chat_round_trip_of_odd_turns(spark):
    rows = [(1, 0, "system", "s#### ###"), (1, 1, "user", None), (1, 2, "assistant", "\\h \\s </turn>\n</turn>"), (None, 0, "assistant", "x"), (2, None, "us:er", "###: "), (2, 1, None, ""), (2, 1, None, ""), (3, 0, "system", "only"), (4, 5, "assistant", "<</turn>" + "y" * 5000)]
    check_chat(spark, rows)
    check_chat(spark, rows, budget=40, history=12)
    assert chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_windows_keep_to_the_budget(spark):
    r = random.Random(5)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "w" * r.randint(1, 160)) for c in range(6) for t in range(r.randint(1, 40))]
    windows = check_chat(spark, rows, budget=120, history=40).collect()
    for w in windows:
        assert w["n_tokens"] <= 120 or w["n_turns"] == 1
        assert w["n_repeated"] == 0 or w["window"] > 0
        for s in w["loss"]:
            assert w["text"][: s["start"]].endswith("### assistant: ")
    assert len(windows) > 12


@given(st.text(alphabet="\\#<>/turnhsl :", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    out = re.sub(r"<(?=/turn>)", r"\\l", re.sub(r"#(?=##)", r"\\h", text.replace("\\", "\\s")))
    assert "###" not in out and "</turn>" not in out
    assert out.replace("\\h", "#").replace("\\l", "<").replace("\\s", "\\") == text


# 2 and 3


def junk(seed):
    return " ".join(w.upper() + "!!" for w in prose(seed, 40).split())


def test_quality_on_held_out_rows(spark, odd, none):
    rows = [(k, junk(k) if k % 3 == 0 else prose(k, 60), "en", "a", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    assert sum(got[k]["predicted"] == int(k % 3 != 0) for k in range(200, 300)) >= 98
    extra = quality.classify(odd.withColumn("score", F.lit("mine")).withColumn("at", F.lit(1)), model)
    assert extra.count() == len(odd_rows()) and extra.where("score is null or score < 0 or score > 1").count() == 0
    assert abs(extra.where("doc_id = 2").first()["score"] - model.prior) < 1e-9
    assert quality.classify(none, model).count() == 0
    assert quality.fit(none, labels) is None
    assert {r["score"] for r in quality.classify(odd, None).collect()} == {0.5}


def test_language_on_held_out_rows(spark, odd, none):
    kinds = {"en": "the and of to in is that with".split(), "de": "der die und das ist nicht mit ein".split(), "fr": "le la les et est une dans pour".split()}
    rows = []
    for k in range(360):
        lang = list(kinds)[k % 3]
        rows.append((k, " ".join(random.Random(k).choices(kinds[lang], k=30)), lang, "a", 0))
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs.where("doc_id < 240"))
    got = langid.identify(docs.where("doc_id >= 240"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 118
    assert sum(r["rejected"] for r in got) == 0
    out = {r["doc_id"]: r for r in langid.identify(odd.withColumn("rejected", F.lit(3)), model).collect()}
    assert [out[k]["lang_pred"] for k in (1, 2, 6)] == ["und"] * 3 and out[1]["rejected"] and out[8]["lang_pred"] in kinds
    assert langid.identify(spark.createDataFrame([(1, "12 34 !", None, None, 0), (2, "123 é", None, None, 0)], DOCS), model).where("lang_pred = 'und'").count() == 1
    assert langid.fit(none) is None and langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


# 4


def plain_fingerprints(rows):
    """Each document with the next one by descending id; ties by text, null ids last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((r[0], len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "4"])
def test_fingerprints_pair_documents_in_order(spark, odd, none, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        extra = odd.withColumn("fingerprint", F.lit(1)).withColumn("__id2", F.lit(2))
        got = fingerprints.fingerprint_pairs(extra).collect()
        many = [(k * 7 % 101, prose(k, 5 + k % 9), "en", "a", 0) for k in range(101)]
        more = fingerprints.fingerprint_pairs(spark.createDataFrame(many, DOCS).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == plain_fingerprints(odd_rows())
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in more), key=str) == plain_fingerprints(many)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] and by[2]["fingerprint"] == "" and by[10]["near_next"] == 1.0
    assert fingerprints.fingerprint_pairs(none).count() == 0
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(1, "abc def", None, None, 0)], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_phrases_do_not_depend_on_offset():
    inner = prose(3, 400).encode()
    a, b = (np.array(x) for x in fingerprints.fingerprint_names([inner, b"some other words in front " + inner]))
    assert fingerprints.likeness(a, b) > 0.8
    assert fingerprints.likeness(*fingerprints.fingerprint_names([prose(4, 400).encode(), inner])) < 0.2
    alone = fingerprints.fingerprint_names([inner])[0]
    assert (alone == a).all()
    for t in (b"a", b"aaaa", b"ab" * 500, b"a" * 5000):
        assert len(fingerprints.fingerprint_names([t])[0])


# 5


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_alignment_scores_as_the_table_does(a, b):
    assert decontam.align(np.array(a), np.array(b)) == plain_align(a, b)


def test_leaks_are_found_and_dropped(spark, odd, none):
    items = [(k, prose(1000 + k, 30)) for k in range(12)]
    bench = spark.createDataFrame([*items, (None, "x y z"), (99, None), (98, "")], "item_id long, text string")
    edit = items[2][1].split()
    edit[5], edit[11], edit[20] = "changed", "again", "here"
    rows = [(100, prose(1, 50) + " " + items[1][1] + " " + prose(2, 50), None, None, 0), (101, " ".join(edit), None, None, 0), (102, prose(3, 90), None, None, 0), (None, items[3][1].upper(), None, None, 0), (103, " ".join(items[4][1].split()[:8]), None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {(100, 1), (101, 2), (None, 3)} and got[100, 1] == 1.0 and 0.6 < got[101, 2] < 1
    assert sorted(r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()) == [102, 103]
    assert decontam.without_leaks(odd, bench).count() == len(odd_rows())
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(docs, bench.where("false")).count() == 0
    old, decontam.BLOCK_ITEMS = decontam.BLOCK_ITEMS, 3
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()} == set(got)
        assert decontam.without_leaks(docs, bench).count() == 2
    finally:
        decontam.BLOCK_ITEMS = old


@pytest.mark.parametrize("every", [4, 5, 6])
def test_copies_with_every_few_words_changed_are_found(spark, every):
    items = [(k, prose(2000 + k, 30)) for k in range(20)]
    rows = []
    for k, text in items:
        edit = [f"other{k}x{i}" if i % every == every - 1 else w for i, w in enumerate(text.split())]
        rows.append((k, prose(3000 + k, 60) + " " + " ".join(edit) + " " + prose(4000 + k, 60), None, None, 0))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {(k, k) for k, _ in items} and all(0.6 < x < 1 for x in got.values())
    assert decontam.without_leaks(docs, bench).count() == 0


UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


def plain_pairs(text):
    out = []
    for run in re.findall(f"[{UNSPACED}]+|[0-9a-z\x80-\U0010ffff]+?(?=[{UNSPACED}]|[^0-9a-z\x80-\U0010ffff]|$)", re.sub("[\u2010-\u205e\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]", " ", text.lower())):
        out += [run[k : k + 2] for k in range(max(1, len(run) - 1))] if re.match(f"[{UNSPACED}]", run) else [run]
    return out


@given(st.lists(st.text("aB9 é日本語。テスト\u0e01\u0e32ภ😀𠀀“”，한글", max_size=14), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_words_of_scripts_without_blanks_are_pairs(texts):
    names, rows, _ = textvec.words(*textvec.texts(pa.array(texts)), textvec.WORD_GAPS, pairs=True)
    plain = [plain_pairs(t) for t in texts]
    assert np.diff(rows).tolist() == [len(p) for p in plain]
    known = {}
    for word, name in zip((w for p in plain for w in p), names.tolist(), strict=True):
        assert known.setdefault(word, name) == name
    assert len(set(known.values())) == len(known)


def unspaced(seed, n, first=0x4E00, kinds=600):
    r = random.Random(seed)
    return "".join(chr(first + int(kinds * r.random() ** 2)) for _ in range(n))


@pytest.mark.parametrize(("first", "kinds"), [(0x4E00, 600), (0x3041, 80), (0x0E01, 46)])
def test_leaks_in_scripts_without_blanks(spark, first, kinds):
    """Whole, and with every twelfth character replaced, inside longer texts; texts without an item stay."""
    made = functools.partial(unspaced, first=first, kinds=kinds)
    items = [(k, made(5000 + k, 60)) for k in range(6)]
    edited = ["".join("另" if i % 12 == 11 else c for i, c in enumerate(t)) for _, t in items]
    rows = [(k, made(6000 + k, 300) + t + "。" + made(7000 + k, 300), None, None, 0) for k, t in items]
    rows += [(10 + k, made(6100 + k, 300) + t + made(7100 + k, 300), None, None, 0) for k, t in enumerate(edited)]
    rows += [(20 + k, made(6200 + k, 900), None, None, 0) for k in range(20)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {(k, k) for k in range(6)} | {(10 + k, k) for k in range(6)} and all(got[k, k] == 1 for k in range(6))
    assert {r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()} == set(range(20, 40))


# 6

PUBLIC = pytest.importorskip("public_tokenizers") if importlib.util.find_spec("public_tokenizers") else None
needs_tokenizers = pytest.mark.skipif(PUBLIC is None, reason="no public_tokenizers")


@needs_tokenizers
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_long_texts_count_as_whole_ones(name):
    one, many = tokens.load(PUBLIC.path(name))
    r = random.Random(3)
    texts = [prose(k, 900) for k in range(3)] + ["a" * 4000, "  \n\n   x  " * 600, "it's we're <|endoftext|> 12 " * 300, "Übergröße 日本語 😀 " * 200, "".join(r.choice("ab \n'!1é") for _ in range(5000)), "word " * 10 + "z" * 3000 + " word" * 300]
    for t, n in zip(texts, many(texts), strict=True):
        for chunk, overlap in ((700, 90), (1000, 200)):
            assert tokens.count_long(one, t, chunk, overlap) == n, t[:40]


_ODD = st.text(st.sampled_from(list("ab'sé.,;-12 \t\n\r\x0b\x0c\x1c\x85\xa0\u200a\u3000\u180e中字😀\u0301<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@needs_tokenizers
@given(st.lists(_ODD | st.sampled_from(["<|endoftext|> a", "a  b\n\n c", "don't  we'll\n", " ", "", "x" * 200]), min_size=1, max_size=6))
@settings(max_examples=400, deadline=None)
def test_texts_counted_by_runs_count_as_whole_ones(many):
    tokenizer, count = _runs()
    assert count(many) == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in many]


@needs_tokenizers
@given(st.lists(_ODD | st.sampled_from([" a", "  b", "\n c", " don't", " é,", " <|endoftext|>", "x" * 90]), min_size=20, max_size=60))
@settings(max_examples=100, deadline=None)
def test_chunks_counted_by_runs_count_as_whole_texts(parts):
    text = "".join(parts)
    tokenizer, _ = _runs()
    one = tokens.load(str(PUBLIC.path("byte_bpe_50k.json")))[0]
    assert tokens.count_long(one, text, 60, 32, 16) == len(tokenizer.encode(text, add_special_tokens=False).ids)


@needs_tokenizers
@pytest.mark.parametrize("rest", range(40, 181, 20))
def test_chunks_that_end_in_a_special_string_count_as_whole_texts(rest):
    """The right chunk ends inside it, the left, widened, after it."""
    tokenizer, _ = _runs()
    one = tokens.load(str(PUBLIC.path("byte_bpe_50k.json")))[0]
    text = "0" * 121 + "\r" + "0" * 21 + " <|endoftext|>" + "0" * rest
    assert tokens.count_long(one, text, 60, 32, 16) == len(tokenizer.encode(text, add_special_tokens=False).ids)



@functools.cache
def _runs():
    from tokenizers import Tokenizer

    path = str(PUBLIC.path("byte_bpe_50k.json"))
    return Tokenizer.from_file(path), tokens.load(path)[1]


@needs_tokenizers
def test_token_counts_of_odd_rows(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PUBLIC.path("byte_bpe_50k.json"))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(odd.withColumn("n_tokens", F.lit("x")), PUBLIC.path("byte_bpe_50k.json")).collect())
    want = []
    for i, x, *_ in odd_rows():
        n = len(t.encode(x or "", add_special_tokens=False))
        want.append((str(i), len((x or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert tokens.count_tokens(none, PUBLIC.path("byte_bpe_50k.json")).count() == 0


# 7


def test_targets_share_out_and_stop(spark):
    sizes = {"a": 1000, "b": 10, "c": 5000, None: 20, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "__source string, __total long")
    got = {r["__source"]: r["__target"] for r in mixing.source_targets(df).collect()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, full = sum(sizes.values()), {}
    while True:
        total = sum(w for s, w in weight.items() if s not in full)
        share = {s: (left - sum(full.values())) * w / total for s, w in weight.items() if s not in full}
        over = [s for s, x in share.items() if x > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3.0 * sizes[s] for s in over}
    want = share | full
    assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_mix_meets_its_targets(spark, odd, none):
    r = random.Random(9)
    rows = [(k, prose(k, r.randint(0, 60)), "en", r.choice("aaaaabbcd") if k % 11 else None, 0) for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 900 and all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in got)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for x in got:
        taken[x["source"]] += x["taken"]
        size[x["source"]] += x["size"]
        target[x["source"]] = x["target"]
        assert len(x["text"].split()) == x["size"]
    for s in target:
        assert abs(taken[s] - target[s]) <= max(30, 0.02 * target[s]), (s, taken[s], target[s])
        assert all(x["source_size"] == size[s] for x in got if x["source"] == s)
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7)).select("doc_id", "taken").collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)
    assert mixing.mix(odd.withColumn("size", F.lit("s"))).count() == len(odd_rows()) and mixing.mix(none).count() == 0


def test_mix_counts_rows_that_are_alike(spark):
    """Repeated rows, null ids and ties: what a source takes is within one document of its target."""
    ten = "w " * 10
    cases = {
        "one id": [(7, ten, "en", "a", 0)] * 200 + [(k, ten, "en", "b", 0) for k in range(1000, 1040)],
        "null ids": [(None, ten, "en", "a", 0)] * 200 + [(k, ten, "en", "b", 0) for k in range(1000, 1110)],
        "both, other texts": [(7, ten, "en", "a", 0)] * 60 + [(7, "v " * 10, "en", "a", 0)] * 60 + [(None, f"t{k} " * 10, "en", "a", 0) for k in range(80)] + [(k, ten, "en", None, 0) for k in range(1000, 1050)],
    }
    for name, rows in cases.items():
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        got = mixing.mix(df).collect()
        assert len(got) == len(rows), name
        for s in {x["source"] for x in got}:
            own = [x for x in got if x["source"] == s]
            left = own[0]["target"] - sum(x["taken"] for x in own)
            assert 0 <= left < 10 and max(x["copies"] for x in own) - min(x["copies"] for x in own) <= 1, (name, s, left)
        again = mixing.mix(df.repartition(5)).groupBy("doc_id", "text", "source", "copies").count().collect()
        assert sorted(map(str, again)) == sorted(map(str, spark.createDataFrame([(x["doc_id"], x["text"], x["source"], x["copies"]) for x in got], "doc_id long, text string, source string, copies int").groupBy("doc_id", "text", "source", "copies").count().collect())), name


def test_mix_goes_on_until_nothing_fits(spark):
    r = random.Random(3)
    rows = [(k, "w " * (r.randint(3000, 30000) if k % 40 == 7 else r.randint(20, 60)), "en", "abcd"[k % 4], 0) for k in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    for s in "abcd":
        own = [x for x in got if x["source"] == s]
        left = own[0]["target"] - sum(x["taken"] for x in own)
        copies = max(x["copies"] for x in own)
        assert 0 <= left <= max(mixing.SLACK * own[0]["target"], min((x["size"] for x in own if x["copies"] < copies), default=0)), (s, left)


def test_mix_fills_what_giant_documents_leave(spark):
    rows = [(k, "w " * (30_000 if k // 4 % 300 == 7 else 50), "en", "abcd"[k % 4], 0) for k in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    for s in "abcd":
        own = [x for x in got if x["source"] == s]
        left = own[0]["target"] - sum(x["taken"] for x in own)
        copies = max(x["copies"] for x in own)
        assert 0 <= left < min(x["size"] for x in own if x["copies"] < copies), s
        assert any(x["size"] == 50 and x["copies"] < copies for x in own)



# 8


def plain_lines(rows):
    docs = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and t is not None and len(key(x)) >= 20:
                docs[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(docs[key(x)]) >= 3 and max(docs[key(x)]) != i)]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_shared_lines_stay_once(spark, odd, none):
    r = random.Random(2)
    lines = [prose(k, 4) for k in range(30)] + ["short", "é" * 19, "É" * 20, "  Padded line of twenty chars \t"]
    rows = [(k % 60, "\n".join(r.choice(lines).upper() if r.random() < 0.2 else r.choice(lines) for _ in range(r.randint(0, 12))), "en", "a", 0) for k in range(80)]
    for data, df in ((rows, spark.createDataFrame(rows, DOCS).repartition(6)), (odd_rows(), odd.withColumn("n_lines", F.lit("x")))):
        got = sorted((str(x["doc_id"]), x["text"], x["n_lines"], x["n_dropped"]) for x in linededup.dedup_lines(df).collect())
        assert got == plain_lines(data)
    assert linededup.dedup_lines(none).count() == 0
    old, linededup.MAX_BITS, linededup.BITS_PER_LINE = (linededup.MAX_BITS, linededup.BITS_PER_LINE), 1 << 16, 1
    try:  # a full filter costs shuffles, not results
        got = sorted((str(x["doc_id"]), x["text"], x["n_lines"], x["n_dropped"]) for x in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
        assert got == plain_lines(rows)
    finally:
        linededup.MAX_BITS, linededup.BITS_PER_LINE = old


# 9


def test_shared_lines_beyond_the_checked_sizes(spark, monkeypatch):
    r = random.Random(5)
    lines = [prose(900 + k, 6) for k in range(40)]
    rows = [(k, "\n".join(r.choice(lines) if r.random() < 0.5 else prose(k * 50 + j, 5) for j in range(r.randint(0, 12))), "en", "a", 0) for k in range(120)]
    rows += rows[:5] + [(None, rows[0][1], "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = sorted((str(x["doc_id"]), x["text"], x["n_lines"], x["n_dropped"]) for x in linededup.dedup_lines(df).collect())
    assert sum(x[3] for x in want) > 100
    for name, value in (("SENT", 0), ("MAX_BITS", 1 << 16)):
        with monkeypatch.context() as m:
            m.setattr(linededup, name, value)
            got = sorted((str(x["doc_id"]), x["text"], x["n_lines"], x["n_dropped"]) for x in linededup.dedup_lines(df).collect())
        assert got == want, name


def test_licenses_by_place(spark, odd, none):
    texts = {
        1: "Released under the MIT License. And the mit-license again",
        2: "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        3: "the license of mit apache or the public general license",
        4: prose(1, 40) + " This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        5: "",
        6: "Licensed under CC BY-NC 4.0.",
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 3, 7, "mit")
    assert got[2]["base_labels"] == "" and got[2]["labels"] == "mit" and got[2]["score"] > 0.9
    assert got[3]["labels"] == "" and got[3]["first_word"] is None and got[3]["score"] == 0
    assert got[4]["labels"] == "gpl" and got[4]["first_word"] == 40 + 19
    assert got[5]["n_words"] == 0 and got[6]["labels"] == "cc-by-nc"
    assert licenses.scan(odd.withColumn("labels", F.lit(1))).count() == len(odd_rows()) and licenses.scan(none).count() == 0


def test_a_file_of_many_notices_has_all_their_labels(spark):
    notices = [t for _, t, _ in licenses.TEMPLATES]
    texts = {
        1: ". ".join(notices[k] for k in (7, 1, 8)),
        2: " -- ".join(notices),
        3: ". ".join([*(n for n in notices if "cc by" not in n), prose(1, 2000), notices[6]]),
        # the first two places have more votes than the last, but not the key phrase
        4: "redistribution and use in source or binary forms with or without modification are permitted. " * 2 + "redistribution and use in source and binary forms with or without modification are welcome",
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd,mit,mpl" and got[1]["base_labels"] == "" and got[1]["score"] == 1.0
    assert got[2]["labels"] == ",".join(sorted({label for label, *_ in licenses.TEMPLATES}))
    assert "cc-by" in got[3]["labels"].split(",") and "cc-by-nc" not in got[3]["labels"].split(",")
    assert got[4]["labels"] == "bsd" and abs(got[4]["score"] - 6 / 7) < 1e-9


def test_many_notices_have_the_labels_that_sql_gives(spark, tmp_path):
    import duckdb

    from loomgraph.llm.oracles import LICENSES

    r, notices = random.Random(2), [t for _, t, _ in licenses.TEMPLATES]
    docs = [(k, ". ".join(r.choice(notices) if r.random() < 0.7 else " ".join(x for x in r.choice(notices).split() if r.random() < 0.8) for _ in range(r.randint(0, 7)))) for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    got = {tuple(x[c] for c in names): round(x["score"], 6) for x in licenses.scan(spark.read.parquet(f"{tmp_path}/documents")).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = {x[:-1]: round(x[-1], 6) for x in con.execute(f"select {', '.join(names)}, score from ({LICENSES})").fetchall()}
    assert got == want and len({x[-1] for x in got}) > 50


# 10


def plain_components(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    nodes = [(i, s) for i, ss in sets.items() for s in ss if i is not None and s]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[k + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in sets}


def near_rows(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = (prose(k % 9, 120) if k % 3 else prose(1000 + k, 80)).split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "edit" + str(r.random())
        out.append((k * 3, " ".join(w), "en", "a", 0))
    return out


@pytest.mark.parametrize("small", [48, 4])
def test_near_duplicates_as_all_pairs_give_them(spark, odd, none, small):
    old, neardup.SMALL, neardup.BLOCK = (neardup.SMALL, neardup.BLOCK), small, small * 2
    try:
        rows = near_rows(small, 140)
        got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == plain_components(rows, 5, 80)
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
        if small == 48:
            out = neardup.near_duplicates(odd.withColumn("kept", F.lit("x")), width=4).collect()
            want = plain_components([r for r in odd_rows() if r[0] is not None], 4, 80)
            assert len(out) == len(odd_rows()) and all(r["component_id"] == want.get(r["doc_id"]) for r in out)
            assert {r["doc_id"]: r["n_shingles"] for r in out}[9] == 1 and {r["doc_id"]: r["n_shingles"] for r in out}[1] == 0
            assert neardup.near_duplicates(none).count() == 0
    finally:
        neardup.SMALL, neardup.BLOCK = old


def test_a_pair_is_linked_though_its_sketches_agree_little(spark):
    for k in range(200_000):
        w = [f"w{k}x{i}" for i in range(45)]
        pair = [" ".join(w[:41]), " ".join(w[:36] + w[41:])]  # 36 of 45 words in common
        a, b = (neardup._sketch(x) for x in neardup._sets(pa.array(pair), 1))
        if 28 <= (a == b).sum() <= 32:
            break
    assert 28 <= (a == b).sum() <= 32
    got = neardup.near_duplicates(spark.createDataFrame([(1, pair[0], "en", "a", 0), (2, pair[1], "en", "a", 0)], DOCS), width=1).collect()
    assert {r["component_id"] for r in got} == {1}


def test_pairs_just_above_the_threshold_are_linked_in_small_and_large_nodes(spark):
    """160 pairs of J from 0.80 to 0.85, each alone; then the same in groups that share most of their words."""
    r = random.Random(11)
    alone, groups = [], []
    for k in range(160):
        n = r.choice([20, 45, 90, 180, 400])
        own = max(1, int(n * r.uniform(0.1765, 0.222) / 2))  # 2 * own words of n + own are not in common
        w = [f"p{k}x{i}" for i in range(n + own)]
        alone += [(2 * k, " ".join(w[:n])), (2 * k + 1, " ".join(w[own:]))]
    for k in range(2):
        core = [f"g{k}x{i}" for i in range(200)]
        for j in range(90):
            own = [f"g{k}y{j}z{i}" for i in range(120)]
            groups += [(1000 * (k + 1) + 2 * j, " ".join(core + own)), (1000 * (k + 1) + 2 * j + 1, " ".join(core + own[:70] + [f"g{k}v{j}z{i}" for i in range(20)]))]
    for texts in (alone, groups):
        got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts], DOCS), width=1).collect()}
        assert got == plain_components([(i, t, "en", "a", 0) for i, t in texts], 1, 80)


def test_linked_is_exact():
    r = np.random.RandomState(1)
    sets = [np.unique(r.choice(60, r.randint(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = neardup._linked(sets, sets, 50, 100)
    assert (neardup._linked(sets[:15], sets[15:], 50, 100) == got[:15, 15:]).all()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)))


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + r.randrange(50), 200 + r.randrange(50)) for _ in range(40)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for ab in links for x in ab}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for ab in links if ab[0] != ab[1] for x in ab}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


