"""The opN queries against their SQL, and models against plain versions of their formulas."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import decontam, fingerprints, langid, quality
from loomgraph.llm.oracles import ORACLES
from loomgraph.llm.queries import QUERIES
from tests.conftest import SMALL, rows
from tests.llm.test_llm_operators import DOCS, needs_tokenizers, plain_align, prose


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


COLUMNS = {
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert set(COLUMNS[name]) <= set(got.columns)
    assert sorted(got["doc_id"]) == sorted(x for (x,) in duck.execute("select doc_id from documents").fetchall())
    for c in ("score", "near_edited", "near_next"):
        if c in got.columns:
            assert got[c].between(0, 1).all()


def texts_of(column):
    data = "".join(column).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in column)])
    return np.frombuffer(data, np.uint8), offsets


def test_votes_are_those_of_a_plain_loop_over_all_neighbours():
    r = random.Random(4)
    train = [prose(k, 40) if k % 2 else " ".join(w.upper() for w in prose(k, 40).split()) for k in range(120)]
    labels = np.array([float(k % 2) for k in range(120)])
    model = quality.train(quality._counts(*texts_of(train)), labels)
    asked = [prose(500 + k, r.randint(1, 80)) for k in range(20)] + train[:3] + ["X", "A B " * 30]
    counts = quality._counts(*texts_of(asked))
    got = model.scores(counts)
    for k in range(len(asked)):
        share = [math.sqrt(c / max(counts[k].sum(), 1)) * w for c, w in zip(counts[k].tolist(), model.idf.tolist(), strict=True)]
        norm = math.sqrt(sum(x * x for x in share))
        at = np.array(share) / max(norm, 1e-9) @ model.space.astype(float)
        at = at / max(math.sqrt(float(at @ at)), 1e-9)
        cosines = [(sum(a * b for a, b in zip(at.tolist(), v.tolist(), strict=True)), y) for v, y in zip(model.vectors, labels, strict=True)]
        best = sorted(cosines, reverse=True)[: quality.NEIGHBOURS]
        weights = [math.exp((c - 1) / quality.FALL) for c, _ in best]
        want = sum(w * y for w, (_, y) in zip(weights, best, strict=True)) / sum(weights)
        assert abs(got[k] - want) < 1e-3


def test_probabilities_are_those_of_a_plain_softmax():
    kinds = {"en": "the and of to in is that with", "de": "der die und das ist nicht mit ein", "fr": "le la les et est une dans pour"}
    names = [list(kinds)[k % 3] for k in range(180)]
    train = [" ".join(random.Random(k).choices(kinds[x].split(), k=25)) for k, x in enumerate(names)]
    model = langid.train(langid._counts(*texts_of(train)), names)
    asked = ["Der Hund ist nicht hier", "the end of it", "une fois", "12 ab"]
    counts = langid._counts(*texts_of(asked))
    got = model.probabilities(counts)
    for k, row in enumerate(counts):
        held = {b: n for b, n in enumerate(row.tolist()) if n}
        total = sum(held.values())
        logits = [(sum(n * float(model.weights[b, c]) for b, n in held.items()) / total + float(model.bias[c])) / model.temperature for c in range(3)]
        e = [math.exp(x - max(logits)) for x in logits]
        assert np.allclose(got[k], [x / sum(e) for x in e], atol=1e-3)
    assert model.languages[int(got[0].argmax())] == "de"


def plain_names(text: bytes) -> list[int]:
    """Phrase names by the rules, one name at a time."""
    mask, least = (1 << 64) - 1, fingerprints._BYTE

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def coin(names):
        out = []
        for k, x in enumerate(names):
            if k == 0:
                place = 0
            else:
                differ = x ^ names[k - 1]
                place = (differ & -differ).bit_length() - 1 if differ else 8 * (8 if max(names) > 255 else 1)
            out.append(2 * place + (x >> place & 1))
        return out

    names, found = [int(least[b]) for b in text], set()
    for level in range(1, max(fingerprints.LEVELS) + 1):
        runs: list[list[int]] = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        units = [x if n == 1 else mixed((x + n * 0x9E3779B97F4A7C15) & mask) for x, n in runs]
        label = coin(units)
        for _ in range(3):
            label = coin(label)
        for c in (3, 4, 5):
            for k in [k for k, x in enumerate(label) if x == c]:
                near = {label[j] for j in (k - 1, k + 1) if 0 <= j < len(label)}
                label[k] = min({0, 1, 2} - near)
        inner = range(1, len(label) - 1)
        top = {k for k in inner if label[k - 1] < label[k] > label[k + 1]}
        low = {k for k in inner if label[k - 1] > label[k] < label[k + 1] and k - 1 not in top and k + 1 not in top}
        cuts = sorted({0} | top | low)
        names = []
        for a, b in zip(cuts, [*cuts[1:], len(units)], strict=True):
            total, step = 0, 0xD6E8FEB86659FD93
            for x in units[a:b]:
                total, step = (total + x * step) & mask, step * 0xD6E8FEB86659FD93 & mask
            names.append(mixed((total + level) & mask))
        if level in fingerprints.LEVELS:
            found |= {x >> 32 for x in names}
    return sorted(found)[: fingerprints.KEPT]


def test_phrases_are_those_of_a_plain_parser():
    r = random.Random(6)
    asked = [prose(k, r.randint(1, 60)).encode() for k in range(25)] + ["Ünïcödé 😀 ".encode() * 20, b"a", b"ab", b"aaaa", b"ab" * 90, b"abc" * 50 + b"z" * 40]
    got = fingerprints.fingerprint_names(asked)
    for text, names in zip(asked, got, strict=True):
        assert names.tolist() == plain_names(text), text[:40]


def plain_words(text):
    out, word = [], ""
    for ch in text:
        ch = ch.lower() if ch.isascii() else ch
        if not ch.isascii() or ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def test_leaks_are_those_of_aligning_all_pairs(spark):
    """Edited copies with a whole n-gram left: the same pairs as aligning every item with every text."""
    r = random.Random(12)
    items = [(k, prose(7000 + k, r.randint(8, 24))) for k in range(15)]
    docs = []
    for k in range(60):
        edit = items[k % 15][1].split()
        for _ in range(r.randint(0, len(edit))):
            at, how = r.randrange(len(edit)), r.random()
            if how < 0.6:
                edit[at] = r.choice(["changed", "words", "here"])
            elif how < 0.8 and len(edit) > 4:
                del edit[at]
            else:
                edit.insert(at, "added")
        docs.append((k, prose(8000 + k, r.randint(0, 40)) + " " + " ".join(edit) + " " + prose(9000 + k, r.randint(0, 40)), None, None, 0))
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            own, other = plain_words(item), plain_words(text)
            grams = lambda ws: {tuple(ws[j : j + decontam.SEED]) for j in range(len(ws) - decontam.SEED + 1)}
            score = plain_align(own, other) / (2 * len(own))
            if score >= decontam.LEAST and grams(own) & grams(other):
                want[d, i] = score
    assert set(got) == set(want) and 15 < len(want) < 60
    assert all(abs(got[k] - want[k]) < 0.05 for k in want)


@needs_tokenizers
def test_token_counts_of_the_given_documents(spark, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {x["doc_id"]: x for x in QUERIES["op6_token_counts"](spark, SMALL).collect()}
    for doc, text in duck.execute("select doc_id, text from documents").fetchall():
        n = len(plain.encode(text or "", add_special_tokens=False).ids)
        assert (got[doc]["n_tokens"], got[doc]["n_bytes"], got[doc]["over_limit"]) == (n, len((text or "").encode()), n > 1024)


def test_leaks_of_the_given_documents(spark):
    found = Counter(x["item_id"] for x in QUERIES["op5_benchmark_leaks"](spark, SMALL).collect())
    assert found


def test_texts_of_an_arrow_column_are_read_as_given():
    from loomgraph.llm.textvec import texts

    data, offsets = texts(pa.array(["ab", None, "ü"]))
    assert bytes(data[offsets[0] : offsets[-1]]) == "abü".encode()
