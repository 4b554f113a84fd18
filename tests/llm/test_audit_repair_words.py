"""Filter audit, conversation repair and word encoding against brute force and the library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from daybook.llm import filter_audit, turn_repair, word_codec

# ------------------------------------------------------------- filter audit

DOCS = "doc_id long, text string, source string, mask string, n long, digest int"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def brute_audit(rows, labels):
    own = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = own.get(i, (False, False))
            own[i] = (good or quality == 1, bad or toxic == 1)
    failing = []
    for i, text, source in rows:
        text = text or ""
        w = words(text)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            fails.add("E")
        failing.append((source or "", fails, *own.get(i, (False, False))))
    out = {}
    for part in {p for p, *_ in failing}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in failing if x[0] == part]
            for step, f in enumerate(order, 1):
                goes = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                every = [x for x in failing if x[0] == part and f in x[1]]
                out[part, order, step] = [len(left), len(goes), len(every) - len(goes), sum(x[1] == {f} for x in every), sum(x[2] for x in goes), sum(x[3] for x in goes)]
                shapley[f] += len(goes)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 5)))
    rows = []
    for i in range(40):
        text = rng.choice([" ", "\n", "\t\v"]).join(word() for _ in range(rng.choice([0, 3, 199, 200, 260])))
        if rng.random() < 0.3:
            text = "Ab aB AB " * rng.randint(1, 90) + text
        if rng.random() < 0.2:
            text += rng.choice("#$%&*|")
        rows.append((i, text, rng.choice(["a", "b", None, ""])))
    rows += [(100 + i, rows[i % 7][1], "a") for i in range(20)]  # copies
    rows += [(5, rows[5][1], "b"), (None, rows[1][1], "a"), (200, None, None), (201, "", "a"), (202, "a " * 150_000, "b"), (203, "x" * 300_000 + " y", "b"), (204, "  　", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_audit_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(filter_audit, "CHUNK", chunk)
    rows = audit_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 45, 2)] + [(4, 1, None), (None, 1, 1), (999, 1, 1), (6, None, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    own = spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in labels], "doc_id long, quality int, toxic int, n string")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(docs, own).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(docs.where("false"), own).count() == 0


def test_distinct_words_survive_equal_hashes(monkeypatch):
    texts = ["a b a c", "", "ab ab ba", "q" * 100 + " " + "q" * 99 + "r " + "q" * 100, "x y"]
    scanner = filter_audit.Scanner()
    data, bounds = filter_audit.text_bytes(pa.array(texts))
    want = [len(set(words(t))) for t in texts]
    assert scanner.counts(data, bounds)["distinct"].tolist() == want
    monkeypatch.setattr(scanner, "_hashes", lambda d, b: np.zeros(sum(len(words(t)) for t in texts), np.uint64))
    assert scanner.counts(data, bounds)["distinct"].tolist() == want


# -------------------------------------------------------------- turn repair

STEP = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}


def brute_repair(faults):
    """Least (cost, audit) over all edits, by relaxing every state; faults: (letter, fault) a turn."""

    def inserting(best):
        while True:
            more = dict(best)
            for p, (c, a) in best.items():
                q = "a" if p == "u" else "u"
                more[q] = min(more.get(q, (10**9, "")), (c + 3, a + "I"))
            if more == best:
                return best
            best = more

    best = inserting({"": (0, "")})
    for letter, fault in faults:
        after = {}

        def put(q, v):
            after[q] = min(after.get(q, v), v)

        for p, (c, a) in best.items():
            put(p, (c + 4, a + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            put("a" if p == "u" else "u", (c + 3 + more, a + "R"))
            if p in STEP.get(letter, {}):
                put(STEP[letter][p], (c + more, a + "K"))
        best = inserting(after)
    return min(v for q, v in best.items() if q in ("", "a"))


@pytest.mark.parametrize("block", [64, 1, 3])
def test_layers_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rng = random.Random(block)
    fault_code = {None: 0, "truncated": turn_repair.CUT, "blank": turn_repair.GONE, "duplicate": turn_repair.GONE}
    for _ in range(400):
        faults = [(rng.choice("suuaaat "), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 12))]
        codes = bytes((turn_repair.LETTERS.index(c) if c in "sua" else turn_repair.NONE) | fault_code[f] for c, f in faults)
        assert turn_repair.repair(codes) == brute_repair(faults)


def brute_conversations(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults, illegal = set(), [], 0
        for i, (_, role, text) in enumerate(turns):
            inside = text.strip(" \t\n\v\f\r")
            fault = "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append((role[:1], fault))
            illegal += i > 0 and turns[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = brute_repair(faults)
        lines, state, left = [], "", list(turns)
        for e in audit:
            role, text = ("", "") if e == "I" else left.pop(0)[1:]
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        known = [t for t, _, _ in turns if t is not None]
        count = Counter(f for _, f in faults)
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def test_repair_against_brute_force(spark):
    rng = random.Random(8)
    says = ["Hi.", "Yes!\n", "No", " ", "", None, "é?", "one two ", "x" * 40 + ".a.", "x" * 40 + ".b.", "end. "]
    rows = []
    for conv in [*range(60), None]:
        for k in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((conv, rng.choice([k, k, k, None, k // 2]), rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant", ""]), rng.choice(says)))
    rows += [(500, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(400)]  # more than a block
    rows += [(600, 0, "user", "long " * 100_000 + "."), (600, 1, "assistant", "a.")]
    rows += [(700, 3, "user", "Again."), (700, 3, "user", "Again.")]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    schema = "conv_id long, turn long, role string, text string, lost string, digest int, audit string"
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    got = turn_repair.repaired_conversations(turn_repair.damage(table))
    found = got.collect()
    assert Counter(tuple(r) for r in found) == brute_conversations(rows)
    gone = next(r for r in found if r.conv_id == lost)
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turn_repair.repaired_conversations(turn_repair.damage(table.where("false"))).count() == 0
    clean = turn_repair.repairs(turn_repair.undamaged(table.where("conv_id = 500"))).first()
    assert (clean.cost, clean.audit) == (0, "K" * 400)


# --------------------------------------------------------------- word codec

TEXTS = ["", " \n", "Don't SAY 'twas  2024½²٣!", "<|endoftext|>b<|startoftext|><|endoftext|> x", "İΣ aΣ ς ﬁ", "é ́x Å", "中文 字　かな 한글", "\x1c\x85﻿‍", "😀😀 ok", "naïve ÇA öß", "a<|b|>c", "'s't've''s"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = word_codec.default_model()
    with open(path, "rb") as f:
        return word_codec.WordCodec(f.read()), Tokenizer.from_file(path)


def check(both, texts):
    codec, library = both
    for text, (ids, shown) in zip(texts, codec.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert shown == codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_words_equal_the_library(both):
    rng = random.Random(4)
    check(both, TEXTS)
    check(both, ["".join(rng.choice(["a", "the", "'s", " ", chr(rng.randrange(32, 0x2FFF)), chr(rng.randrange(0x10000, 0x1F900)), *TEXTS[2:5]]) for _ in range(rng.randint(1, 12))) for _ in range(1500)])


def test_long_words_and_small_caches(both):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=n))
    check(both, [letters(300_000), "ab" * 100_000, "the cat " * 100_000, *(letters(n) for n in range(1, 200))])
    small = word_codec.WordCodec(open(word_codec.default_model(), "rb").read(), cache_size=5)
    for _ in range(3):
        check((small, both[1]), [" ".join(letters(rng.randint(1, 9)) for _ in range(20)) for _ in range(10)])


def test_cuts_are_places_no_token_spans(both):
    codec, _ = both
    word = "abézqx中x".encode()
    cuts = {a for a, _ in codec.fragments([b"zz", word])[1]} - {2}
    cuts = {a - 2 for a in cuts}
    tokens = [(bytes(map(codec.bytes_of.__getitem__, t.removesuffix("</w>"))), t.endswith("</w>")) for i, t in codec.surface.items() if not t.startswith("<|")]
    for i in range(1, len(word)):
        last = i == len(word) - 1
        inside = any((t.endswith(word[i - 1 : i + 1]) and ends) if last else word[i - 1 : i + 1] in (t[:-1] if ends else t) for t, ends in tokens)
        assert (i in cuts) == (not inside)


def test_word_round_trip(spark, both):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (90, None), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = Counter(tuple(r) for r in word_codec.round_trip(docs, word_codec.default_model()).collect())
    want = Counter()
    for i, t in rows:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert word_codec.round_trip(docs.where("false"), word_codec.default_model()).count() == 0
    coded = docs.select("text", word_codec.encoder(spark, word_codec.default_model())("text").alias("ids"))
    back = coded.select("text", word_codec.decoder(spark, word_codec.default_model())("ids").alias("said")).collect()
    assert all(r.said == both[1].decode(both[1].encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in back)
