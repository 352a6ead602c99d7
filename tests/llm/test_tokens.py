"""Operators 5 and 6 against plain versions of what they do."""

import hashlib
import random

import public_tokenizers
import regex

from inkframe.llm import bpe, queries, wordpiece

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding as defined: the lowest-ranked neighbours merge until none can."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:] + [b"\xff" * 99])))
        if best[0] == 1 << 30:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ids_are_those_of_the_merges(spark, docs):
    enc = bpe.encoding(PATH, PATTERN)
    ranks = enc._mergeable_ranks
    texts = ["", None, "Hello  world's 12 é　\n\n x", " \t ", "a" * 50, "été 😀 don't", "x\r\n  y  "]
    out = docs(list(enumerate(texts))).select("doc_id", bpe.encoder(PATH, PATTERN)("text").alias("ids")).collect()
    for r in out:
        text = texts[r.doc_id] or ""
        assert r.ids == [i for m in regex.findall(PATTERN, text) for i in merged(m.encode(), ranks)]


def test_long_texts_split_at_safe_places(monkeypatch):
    enc = bpe.encoding(PATH, PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "é", " ", "  ", "\n", "7", "42", "'s", "!?", "　", "\x1c"]) for _ in range(400)) for _ in range(60)]
    texts += [" " * 90, " " * 90 + "a", "a" + "\n" * 70 + " b", "x" * 200]
    monkeypatch.setattr(bpe, "PIECE", 20)
    monkeypatch.setattr(bpe, "_RUN", regex.compile(rf"[{bpe._SPACE}]{{6,}}"))
    monkeypatch.setattr(bpe, "RUN", 6)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (bpe._BOUNDARY, 20))
    for text in texts:
        assert [int(i) for part in bpe.encode_text(enc, text) for i in part] == enc.encode_ordinary(text)


def test_a_million_blanks():
    enc = bpe.encoding(PATH, PATTERN)
    text = "a" + "\n \t" * 400_000 + "b"
    assert b"".join(enc.decode_bytes(p.tolist()) for p in bpe.encode_text(enc, text)) == text.encode()


def test_byte_bpe_query_round_trip(spark, sf):
    got = {r.doc_id: r for r in queries.op6_byte_bpe(spark, sf).collect()}
    enc = bpe.encoding(PATH, PATTERN)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = enc.encode_ordinary(r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def greedy(word, heads, tails):
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (tails if at else heads)), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(5)
    for _ in range(60):
        words = lambda n, top: {"".join(rng.choice("abc") for _ in range(rng.randint(1, top))) for _ in range(n)}
        heads, tails = words(8, 5), words(10, 4)
        a = wordpiece.Automaton(heads, tails)
        for w in words(80, 14):
            assert a.count(w) == greedy(w, heads, tails), (w, heads, tails)


def test_round_trip_of_odd_rows(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both, decode = bpe.round_trip(path, public_tokenizers.PATTERN), bpe.decoder(path, public_tokenizers.PATTERN)
    rows = [(1, None), (2, ""), (None, "é x"), (4, "ab " * 300_000)]
    out = docs(rows).select("doc_id", "size", both("text").alias("b")).collect()
    assert [bytes(r.b.decoded).decode() for r in out] == [t or "" for _, t in rows] and [len(r.b.ids) for r in out[:2]] == [0, 0]
    assert docs([]).select(both("text")).collect() == []
    assert spark.createDataFrame([(None,)], "ids array<int>").select(decode("ids")).first() == (b"",)
    plan = docs(rows).select(both("text").alias("b")).select("b.ids", "b.decoded")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("both(text") == 1  # nothing is encoded twice


def test_token_counts_edges(spark, docs):
    count = wordpiece.counter(public_tokenizers.path("piece_bpe_32k.model"))
    out = docs([(1, None), (2, ""), (3, " \n"), (None, "the the"), (4, "ab " * 300_000), (4, "ab " * 300_000)]).select("doc_id", count("text").alias("c")).collect()
    assert [tuple(r.c) for r in out[:3]] == [(0, 0, 0)] * 3
    assert out[3].c.n_words == 2 and out[4].c.n_words == out[5].c.n_words == 300_000
    assert docs([]).select(count("text")).collect() == []


def marked(word, vocabulary):
    """Greedy longest match over the mark and a word: tokens, and unknown characters among them."""
    text, at, n, unknown = "▁" + word, 0, 0, 0
    while at < len(text):
        end = next((e for e in range(min(len(text), at + 20), at, -1) if text[at:e] in vocabulary and (at == 0 or "▁" not in text[at:e])), None)
        n, unknown, at = n + 1, unknown + (end is None), end or at + 1
    return n, unknown


def test_bare_mark_begins_a_word():
    rng = random.Random(6)
    for _ in range(60):
        words = lambda n, top: {"".join(rng.choice("abc") for _ in range(rng.randint(1, top))) for _ in range(n)}
        heads, tails = words(4, 5), words(8, 4)
        a = wordpiece.Automaton({"", *heads}, tails)
        vocabulary = {"▁", *("▁" + w for w in heads), *tails}
        for w in words(80, 14):
            n, unknown = marked(w, vocabulary)
            assert a.cover(w) == (n, unknown) and a.count(w) == (0 if unknown else n), (w, heads, tails)


def test_token_counts_query(spark, sf, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    texts = dict(enumerate(["ñandú été", "東京に行きました" * 3, "안녕하세요", "αβγ ßheit Ça", "中\U00020000国人", "\U00020000" * 40]))
    out = {r.doc_id: tuple(r.c) for r in docs(list(texts.items())).select("doc_id", wordpiece.counter(path)("text").alias("c")).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_token_counts(spark, sf).collect()}
    for text, found in [*((texts[i], out[i]) for i in texts), *((r.text, got[r.doc_id]) for r in rows)]:
        counts = [marked(w, vocabulary) for w in wordpiece.WORD.findall(text)]
        assert found == (len(counts), sum(n for n, _ in counts), sum(u for _, u in counts)), text
    assert out[2][1] >= 5 and out[5][1:] == (41, 40)
