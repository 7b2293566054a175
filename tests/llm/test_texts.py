"""Tokens, personal data, language and line templates beside brute force."""

import base64
import random
import re
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from sievewatch.llm import bpe, language, pii, templates

DOCS = "doc_id long, text string, lang string, count long, text_sha256 string"


def table(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang, 7, "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "aa", "A", " ", "  ", "\n", "\t", "é", "ß", "1", "12", "!", "'s", "'", "日本", "😀", "\x1c", "\x85", "\u3000", "the", "a.\nb",
         "ing", "word,", "=====", "½", "\u0300", "<|endoftext|>", " The"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_coder_equals_reference(reference, name):
    coder = bpe.Coder(bpe.read_vocabulary(P.path(name)), P.PATTERN)
    rnd = random.Random(5)
    for _ in range(3000):
        t = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30)))
        assert "".join(bpe.pieces(t)) == t
        ids = coder.encode(t)
        assert ids.tolist() == reference.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()
    assert len(coder.encode(None)) == 0
    long = "x" * 5000 + " " + "ab, " * 20000
    assert coder.encode(long).tolist() == reference.encode_ordinary(long)


def test_split_characters():
    coder = bpe.Coder(bpe.read_vocabulary(P.path("byte_bpe_50k.json")))
    text = "é日本 x"
    ids = coder.encode(text)
    assert coder.offsets(ids, text.encode()).tolist() == [0, 1, 1, 2, 2, 3][: len(ids)]
    half = coder.decode(ids[:2])
    assert bpe.decode_text(half).startswith("é") and bpe.decode_text(half).endswith("\ufffd")


def test_encode_documents(spark, reference):
    texts = ["Hello there, you.", None, "", "é" * 50, "Hello there, you."]
    out = {r.doc_id: r for r in bpe.encode_documents(
        table(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, outputs=("ids", "offsets", "n_tokens", "decoded")).collect()}
    for i, t in enumerate(texts):
        assert list(out[i].ids) == reference.encode_ordinary(t or "") and out[i].decoded == (t or "") and out[i].n_tokens == len(out[i].ids)
    assert bpe.encode_documents(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0


# --- personal data ---------------------------------------------------------------------------

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_patterns():
    rnd = random.Random(3)
    alphabet = [*"ab.@-_%+ 0123459", "1.2.3.4", "@x.y", "+1 (2", "4111 1111 1111 1111", "é", "٣", "300.1.1.1", "\n", "12345678", "iban ", "http://"]
    for _ in range(20000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 22)))
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == base_spans(t), t


def test_added_spans_and_mask(spark):
    text = "IBAN: GB82 WEST 1234 5698 7654 32. see http://bob@host/x or ssn 123-45-6789, password=abc12345xyz; a@b.co"
    kinds = [text[s:e] for _, s, e in pii.find_spans(text)]
    assert "GB82 WEST 1234 5698 7654 32" in kinds and "123-45-6789" in kinds and "abc12345xyz;"[:-1] in kinds
    assert pii.find_spans("an iban is a number; http://host/path is open") == []
    docs = table(spark, [text, None, "", "plain words"]).withColumn("n_chars", F.lit(1))
    out = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert out[1].text is None and out[2].text == "" and out[3].text == "plain words" and out[3].n_chars == 11
    assert "@" not in out[0].text and "GB82" not in out[0].text and pii.mask(docs).columns == docs.columns
    got = pii.digest(pii.scan(docs)).where("doc_id = 0").first()
    assert got.n_email == len([s for s in base_spans(text) if s[0] == "email"]) and got.n_ip == 0
    assert pii.scan(table(spark, [])).count() == 0


# --- language --------------------------------------------------------------------------------


def test_language(spark):
    rnd = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["über", "straße", "nicht"]}
    rows = [(k, " ".join(rnd.choice(w) for _ in range(rnd.randint(3, 200)))) for k, w in words.items() for _ in range(60)]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string")
    net = language.fit(docs.where("doc_id % 4 != 2"))
    test = language.identify(docs.where("doc_id % 4 = 2"), net).select("lang", "language.*").collect()
    assert np.mean([r.lang == r.label for r in test]) > 0.95 and all(0 <= r.score <= 1 for r in test)
    odd = table(spark, [None, "", "123 !?", "lorem " * 50000, "lorem", "lorem"], "aa")
    got = language.identify(odd, net).orderBy("doc_id").collect()
    assert [r.language.label for r in got] == ["und"] * 3 + ["aa"] * 3 and got[4].language == got[5].language
    kept = language.keep_known(odd, net)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5}
    empty = language.fit(odd.where("lang is null"))
    assert {r.language.label for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(odd.limit(0), net).count() == 0


def test_training_counts_different_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 40)
    hot = [("aa", "hot text of all")] * 400
    rows = hot + [("aa", f"text {i} of one") for i in range(300)] + [("bb", f"text {i} of two") for i in range(30)] + [("bb", "12")] * 50
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(6)
    got = [(r.lang, bytes(r.window)) for r in language.training_windows(docs).collect()]
    assert len(got) == len(set(got)) and {k: sum(x == k for x, _ in got) for k in ("aa", "bb")} == {"aa": 20, "bb": 20}
    # only copies: one text
    copies = docs.where("text = 'hot text of all'")
    assert language.training_windows(copies).count() == 1


def test_floor_of_the_score(spark):
    docs = table(spark, ["words of no known language", "", "12", None, "été"])
    assert {r.doc_id for r in language.keep_known(docs, language.ByteNet([])).collect()} == {0, 4}
    many = language.ByteNet([f"l{i}" for i in range(50)])
    many.out[:] = 0
    many.out_bias[7] = 2  # a probability of 0.13, far above 1 / 50
    assert {r.doc_id for r in language.keep_known(docs, many).collect()} == {0, 4}
    many.out_bias[7] = 0  # all labels alike
    assert language.keep_known(docs, many).count() == 0


def test_windows_cover_all_bytes():
    texts = [b"", b"a", bytes(range(256)) * 3 + b"xyz"]
    windows, owner, length = language.cut(texts)
    assert [b"".join(bytes(w[:n]) for w, o, n in zip(windows, owner, length, strict=True) if o == i) for i in range(3)] == texts


# --- line templates --------------------------------------------------------------------------


def test_line_templates(spark):
    texts = [f"Own words of document {chr(97 + i)} here\nSigned by user{i} on page {i} of the site\n{'x' * i} y z" for i in range(12)]
    texts += [None, "", "Signed by user1 on page 9 of the site", "word\n\nword"]
    out = {r.doc_id: r for r in templates.drop_recurring_lines(table(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i in range(12):
        assert out[i].n_dropped >= 1 and "Signed" not in out[i].text and out[i].n_lines == 3
    assert out[12].text is None and out[12].n_lines == 0 and out[13].text == "" and out[15].text == "word\n\nword"
    assert out[14].text == ""
    assert templates.drop_recurring_lines(table(spark, [])).count() == 0


def test_template_fields_at_every_size(spark):
    # fields without digits: each value is in 8 lines and more, each product of values in fewer
    rnd = random.Random(3)
    word = lambda k, n: f"{k}{chr(97 + n // 26)}{chr(97 + n % 26)}"
    for size in (40, 3000):
        texts = [
            f"Posted on the wall by {word('au', rnd.randrange(50))} about {word('ca', rnd.randrange(20))} in the state {word('st', rnd.randrange(30))}"
            for _ in range(size)]
        texts += [f"Moved over to a {word('x', rnd.randrange(3))} and {word('y', rnd.randrange(4))} or {word('z', rnd.randrange(5))} place" for _ in range(size)]
        # another message of the same leaf, with digits, in a twentieth of its lines or less
        texts += [f"Posted on the side of page {i} is a line with a number" for i in range(9)]
        texts += ["Posted on the morning this sentence was written only once ever"]
        out = templates.drop_recurring_lines(table(spark, texts)).collect()
        assert {r.doc_id for r in out if not r.n_dropped} == {len(texts) - 1}


def test_lines_that_recur_word_for_word(spark):
    one = lambda i: f"{chr(97 + i)}{chr(107 + i)}"
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [
        f"Accept all cookies\n2024-01-{i + 1:02} 10:00:00 INFO {i} {i * 7} connected\n2024-01-01 10:00:0{i} {i} 5 closed\n\n}}\n12\n{i} 2 3 4 5"
        for i in range(9)]
    texts += [f"{passage}\nThis is said here by {one(0)}", f"Own {one(1)}\n{passage} "]  # a passage of two documents
    texts += ["Seldom said but said"] * 4 + ["Said in three texts only"] * 3
    # prose with the same beginning is no template
    texts += [f"On the other hand {one(i)} {one(i + 1)}x {one(i)}y {one(i)}z {one(i)}v {one(i)}w" for i in range(12)]
    # repeated ids and texts are one document
    rows = [(i, t, None, 7, "x") for i, t in enumerate(texts)] + [(900, "Stated in one document", None, 7, "x")] * 9
    out = sorted(templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: r.doc_id)
    # one occurrence of what recurs word for word stays
    assert sum("Accept" in r.text for r in out[:9]) == 1
    assert [r.text.replace("Accept all cookies\n", "") for r in out[:9]] == [f"\n}}\n12\n{i} 2 3 4 5" for i in range(9)]
    assert sorted(r.n_dropped for r in out[9:11]) == [0, 1]
    assert [r.text.replace(passage, "").strip() for r in out[9:11]] == [f"This is said here by {one(0)}", f"Own {one(1)}"]
    assert sorted(r.n_dropped for r in out[11:15]) == [0, 1, 1, 1] and [r.n_dropped for r in out[15:18]] == [0] * 3
    assert all(r.n_dropped == 0 for r in out[18:])


def brute_templates(rows):
    """Lines to drop by the rules of the tree, over ``{row: text}``."""
    lines = [(r, i, x) for r, t in rows.items() for i, x in enumerate((t or "").split("\n"))]
    docs, held = {}, {}
    for r, _, x in lines:
        docs.setdefault(x.strip(), set()).add(r)
    drop = set()
    for r, i, x in lines:
        need = templates._needed(templates.line_tokens(x), x)
        if need and len(docs[x.strip()]) >= need:
            held.setdefault(x.strip(), []).append((r, i))
    for places in held.values():
        drop |= set(sorted(places)[1:])
    leaves = {}
    for r, i, x in lines:
        t = templates.line_tokens(x)
        lead = [k for k, w in enumerate(t) if w != "<*>"][: templates.DEPTH]
        if len(t) >= templates.LEAST_TOKENS and lead:
            leaves.setdefault((len(t), tuple(t[: lead[-1] + 1])), []).append((r, i, x.strip(), t, lead[-1] + 1))
    found = {}
    for leaf, members in leaves.items():
        if len({m[0] for m in members}) < templates.LEAST_DOCUMENTS:
            continue
        for r, i, x, t, lead in members:
            for least in (0.0, *templates.SHARES):
                def stays(k, w):
                    n = sum(m[3][k] == w for m in members)
                    return w != "<*>" and (k < lead or least == 0 or (n >= templates.LEAST_DOCUMENTS and n >= least * len(members)))
                kept = [w if stays(k, w) else "" for k, w in enumerate(t)]
                if 2 * sum(map(bool, kept)) > sum(w != "<*>" for w in t):
                    found.setdefault((leaf, tuple(kept)), []).append((r, i, x))
    for members in found.values():
        if len({m[0] for m in members}) >= templates.LEAST_DOCUMENTS and len({m[2] for m in members}) > 1:
            drop |= {(r, i) for r, i, _ in members}
    return drop


@pytest.mark.parametrize("limits", [(400_000, 4096), (0, 3)])
def test_templates_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(templates, "BROADCAST_LEAVES", limits[0])
    monkeypatch.setattr(templates, "BROADCAST_ROWS", limits[0])
    monkeypatch.setattr(templates, "SLICE_LINES", limits[1])
    rnd = random.Random(11)
    word = lambda n: f"w{chr(97 + rnd.randrange(n))}"
    makes = [
        lambda: f"Signed in by {word(4)} from {word(26)} at {rnd.randrange(99)}", lambda: f"Signed in by {word(2)} again",
        lambda: " ".join(word(3) for _ in range(rnd.randint(1, 5))), lambda: "The same long line of all pages", lambda: "", lambda: "ok",
        lambda: f"{word(26)} {word(26)} {word(26)} {word(26)} {word(26)}", lambda: " ".join(["long"] * 55 + [word(12)]),
        lambda: f"{rnd.randrange(9)} {rnd.randrange(9)} 1 2 3"]
    texts = ["\n".join(rnd.choice(makes)() for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    texts += ["A whole document\nof two lines that has many copies"] * 20 + [None, ""]
    rows = {r.k: (r.doc_id, r.text) for r in table(spark, texts).select("doc_id", "text", F.xxhash64(
        F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "text", F.col("text").isNull()).alias("k")).collect()}
    drop = brute_templates({k: t for k, (_, t) in rows.items()})
    want = {}
    for k, (i, t) in rows.items():
        left = [x for n, x in enumerate((t or "").split("\n")) if (k, n) not in drop]
        want[i] = (len((t or "").split("\n")) - len(left), None if t is None else "\n".join(left))
    got = {r.doc_id: (r.n_dropped, r.text) for r in templates.drop_recurring_lines(table(spark, texts).repartition(5)).collect()}
    assert {i: v for i, v in got.items() if v != want[i]} == {}
    assert sum(v[0] for v in got.values()) > 100
    # copies of a whole document: one is left whole
    assert [v[1] for i, v in sorted(got.items())[150:170]].count(texts[150]) == 1


def test_parsers_are_linear():
    n = 100_000
    shapes = ["@", "a@", "a@b ", ".1", "1.", "+1", "+1 ", "1 ", "1-", "iban: ", "iban DE12 ", "ACCT#", "ssn A-", "token=", "token: ", "password=abcdefgh", "http://", "http://a@", "tel:+"]
    for text in [*(s * n for s in shapes), "a" * n + "@" + "b" * n, "http://x?" + "+1" * n, "ACCT " + "A-" * n, "0" * n + ".1.1.1"]:
        start = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - start < 2, text[:20]


def test_long_address_parts():
    text = "0" * 5000 + ".1.1.1 " + "1" * 5000 + ".1.1.1 " + "0" * 5000 + "256.1.1.1"
    assert pii.find_spans(text) == [("ip", 0, 5006)]
    assert pii.find_spans("token=abcd1234token= xyz98765 token=noneofthem token=abcdefg1") == [
        ("secret", 6, 20), ("secret", 21, 29), ("secret", 53, 61)]
