"""Repeated lines against a plain loop in rank order."""

import random
import re

from textmeter.llm import line_dedup

SCHEMA = "doc_id long, text string, removed string"


def plain(rows, min_words=5):
    """{(id, text): (left, spans)}, first occurrence by id and offset."""
    seen, out = set(), {}
    for key, text in sorted({(k, t) for k, t in rows if t}, key=lambda r: (r[0] is None, r[0])):
        at, lines, spans = 0, [], []
        for line in text.split("\n"):
            words = tuple(re.findall(r"\w+", line.lower()))
            if len(words) >= min_words and words in seen:
                spans.append((at, at + len(line)))
            else:
                lines.append(line)
            seen.add(words)
            at += len(line) + 1
        out[key, text] = "\n".join(lines), spans
    return out


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha beta gamma Delta épsilon zeta".split()) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    return [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", "."]) for _ in range(rng.randint(1, 12))) + rng.choice(["", "\n", "\n\n"])) for i in range(n)]


def test_equals_the_plain_loop(spark):
    rows = corpus()
    want = plain(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    got = line_dedup.drop_repeated_units(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        left, spans = want[r.doc_id, text]
        assert [(s.start, s.end) for s in r.removed] == spans
        assert r.text == left or spans and r.text == left.removesuffix("\n")
        kept = line_dedup.kept_spans(len(text), spans)
        assert "".join(text[a:b] for a, b in kept).replace("\n", "") == r.text.replace("\n", "")


def test_paragraphs(spark):
    one, two = "a b c d e\nf g h", "i j k l m n"
    df = spark.createDataFrame([(1, f"{one}\n\n{two}"), (2, f"{two}\n\nnew words are in here\n\n{one}"), (3, "a b c d e\nother end")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_units(df, "paragraph").collect()}
    assert got[1].removed == [] and got[3].removed == []
    assert got[2].text.strip() == "new words are in here"


def test_a_line_most_documents_hold(spark):
    line = "This very line is in nearly all texts"
    df = spark.createDataFrame([(i, f"{line}\nown words of number {i} here") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_units(df).collect()}
    assert got[0].startswith(line) and all(got[i] == f"own words of number {i} here" for i in range(1, 300))


def test_nulls_repeats_long_and_empty(spark):
    long_line = "x " * 200_000 + "end"
    rows = [(None, "one two three four five"), (3, "one two three four five"), (3, "one two three four five"), (1, None), (2, ""),
            (8, long_line), (9, f"short\n{long_line}\nshort"), (7, "one two three four five!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.drop_repeated_units(df).collect()), key=str)
    assert got == sorted([(None, ""), (3, rows[1][1]), (3, rows[1][1]), (1, None), (2, ""), (8, long_line), (9, "short\nshort"), (7, "")], key=str)
    assert line_dedup.drop_repeated_units(df.limit(0)).count() == 0


def plain_sentences(rows):
    """{id: (left, spans)} with lines of any words and sentences of five words, in rank order."""
    units, first = [], {}
    for key, text in rows:
        at = 0
        for line in text.split("\n"):
            words = re.findall(r"\w+", line.lower())
            if words:
                units.append((key, at, at + len(line), at, at + len(line), tuple(words)))
            begin = at
            for part in re.split(r"(?<=[.!?])(?![.!?])", line):
                held = re.findall(r"\w+", part.lower())
                if 5 <= len(held) < len(words):
                    units.append((key, begin, begin + len(part), at, at + len(line), tuple(held)))
                begin += len(part)
            at += len(line) + 1
    for key, a, _, _, _, words in units:
        first[words] = min(first.get(words, (key, a)), (key, a))
    out = {}
    for key, text in rows:
        again = [u for u in units if u[0] == key and first[u[5]] != (key, u[1])]
        lines = {u[3:5] for u in again if u[1:3] == u[3:5]}
        spans = sorted({u[1:3] for u in again if u[1:3] == u[3:5] or u[3:5] not in lines})
        gone = {i for a, b in spans for i in range(a, b)}
        at, left = 0, []
        for line in text.split("\n"):
            kept = "".join(c for i, c in enumerate(line, at) if i not in gone)
            if kept or not line:
                left.append(kept)
            at += len(line) + 1
        out[key] = "\n".join(left), spans
    return out


def test_sentences_inside_lines(spark):
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))).capitalize() + rng.choice([".", "!", "...", "?"]) for _ in range(40)]
    rows = [(i, "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    want = plain_sentences(rows)
    got = line_dedup.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=1, sentence_words=5).collect()
    assert {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed]) for r in got} == want


def test_a_passage_inside_other_lines(spark):
    passage = " ".join(f"Sentence {n} of the passage has some words of its own." for n in range(8))
    rows = [(1, f"First text. {passage} And its end."), (2, f"Something quite different begins here. {passage} It goes on\nand on."), (3, f"{passage}\nlast")]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1, sentence_words=5).collect()}
    assert got == {1: rows[0][1], 2: "Something quite different begins here. It goes on\nand on.", 3: "last"}
