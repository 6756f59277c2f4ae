"""Readers, writers, the error parse and chunk rules."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings, strategies as st

from latentia.functions import text as T
from latentia.operators import corpus as C, errorparse as EP, features as FT, metrics as M, perceptron as PC
from latentia.operators.chain import best_path
from latentia.operators.trees import acyclic, reaches_root
from latentia.sources import readers as R, writers as W
from pyspark.sql import functions as F

SENT = "1\tThe\tthe\tD\tDT\t_\t2\tNMOD\t_\t_\n2\tcat\tcat\tN\tNN\t_\t0\tROOT\t_\t_\n"


def test_conll_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.conll").write_text("\n" + SENT + "\n\n" + SENT.replace("cat", "dog") + "\n" + "1\tA\ta\tD\tDT\t_\t0\tROOT\n")
    got = R.conll_corpus(spark, str(src / "a.conll"))
    assert [(r.sent_id, r.idx, r.form, r.head, r.phead) for r in got.orderBy("sent_id", "idx").collect()] == [(1, 1, "The", 2, "_"), (1, 2, "cat", 0, "_"), (2, 1, "The", 2, "_"), (2, 2, "dog", 0, "_"), (3, 1, "A", 0, "_")]
    W.conll(got.where("sent_id < 3"), str(tmp_path / "out"))
    again = R.conll_corpus(spark, str(tmp_path / "out"))
    assert again.count() == 4
    assert R.conll_corpus(spark, str(src / "a.conll"), first=1).count() == 2


def test_ner_readers(spark, tmp_path):
    (tmp_path / "nl").write_bytes("-DOCSTART- x y\n\ncaf\xe9 N O\nEls N B-PER\n\n\nnu Adv O".encode("latin-1"))
    rows = [(r.sent_id, r.pos, r.word, r.tag) for r in R.ner2002(spark, str(tmp_path / "nl")).orderBy("sent_id", "pos").collect()]
    assert rows == [(1, 0, "café", "O"), (1, 1, "Els", "B-PER"), (2, 0, "nu", "O")]
    (tmp_path / "en").write_text("O\t0\t0\tI-NP\tDT\tThe\tx\tx\t0\nI-PER\t0\t1\tI-NP\tNN\tBob\tx\tx\t0\n\n")
    assert [(r.word, r.tag) for r in R.ner2003(spark, str(tmp_path / "en")).orderBy("pos").collect()] == [("The", "O"), ("Bob", "I-PER")]
    pred = spark.createDataFrame([(1, 0, "a", "O", "B-MISC"), (1, 1, "b", "O", "O"), (2, 0, "c", "B-LOC", "B-LOC")], "sent_id long, pos int, word string, gold string, pred string")
    W.predictions(pred, str(tmp_path / "pred"), muc=True)
    back = R.predictions(spark, str(tmp_path / "pred"))
    assert sorted((r.word, r.gold, r.pred) for r in back.collect()) == [("a", "O", "O"), ("b", "O", "O"), ("c", "B-LOC", "B-LOC")]


def test_vocab_embeddings_brown(spark, tmp_path):
    v = spark.createDataFrame([(0, "a", 5), (1, 'q"', 1)], "id long, word string, freq long")
    W.vocabulary(v, str(tmp_path / "v"))
    assert sorted((r.word, r.freq) for r in R.vocabulary(spark, str(tmp_path / "v")).collect()) == [("a", 5), ('q"', 1)]
    assert R.vocabulary(spark, str(tmp_path / "v"), more_than=1).count() == 1
    e = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [0.0, -1.0])], "word string, rep array<double>")
    W.embeddings(e, str(tmp_path / "e"), header=False)
    assert {r.word: r.rep for r in R.embeddings(spark, str(tmp_path / "e"), v).collect()} == {"a": [1.0, 2.5]}
    (tmp_path / "b").write_text("0010\ta\t3\n0010\tb\t2\n11\tc\t1\n")
    assert {r.cluster: r.words for r in R.brown_words(R.brown(spark, str(tmp_path / "b"))).collect()} == {"0010": ["a", "b"], "11": ["c"]}
    W.brown_map(R.brown(spark, str(tmp_path / "b")), str(tmp_path / "bm"), hot=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "bm")).collect()) == ["a\t1 0", "b\t1 0", "c\t0 1"]
    (tmp_path / "s").write_text("N: 30\nName of the corpus file: x.txt\n")
    assert R.settings(spark, str(tmp_path / "s")) == {"N": "30", "Name of the corpus file": "x.txt"}
    (tmp_path / "t").write_text(" a  b \n\nc\n")
    assert [(r.sent_id, r.words) for r in R.text_corpus(spark, str(tmp_path / "t")).orderBy("sent_id").collect()] == [(1, ["a", "", "b"]), (2, [""]), (3, ["c"])]


def ner(*f):
    return "\t".join(f)


GOOD = ner("O", "0", "1", "I-NP", "DT", "The", "x", "", "0")


@pytest.mark.parametrize(
    "line, reason",
    [
        (GOOD, None), (GOOD.replace("The", '"a\tb"'), None), (GOOD.replace("The", '""""'), None), (GOOD.replace("The", 'a"b'), None),
        (GOOD.replace("The", '"ab'), "quoting"), (GOOD.replace("The", '"a"b'), "quoting"), (GOOD.replace("The", '"""'), "quoting"),
        (GOOD + "\t", "columns"), ("O", "columns"), (GOOD.replace("\tThe", " The"), "columns"), (GOOD.replace("The", '"a\tb'), "quoting"),
        (GOOD.replace("O\t", "B-X\t"), "value"), (GOOD.replace("\t1\t", "\t1.0\t"), "value"), (GOOD.replace("The", ""), "value"), (GOOD.replace("The", '""'), "value"), (GOOD.replace("The", "é"), "value"),
    ],
)
def test_delimited_reasons(line, reason):
    fields, got, cost, edits = EP.parse_delimited(line)
    assert got == reason and (cost == 0) == (reason is None) and bool(edits) == bool(cost) and (fields is None) == (reason is not None)


def raw_fields(line):
    """Fields of a well-formed line with their quotes."""
    out, quotes = [""], EP.START
    for c in EP._symbols(line, '"', "\t"):
        if c == "\t" and quotes != EP.QUOTED:
            out.append("")
        else:
            out[-1] += c
        quotes = EP._step(quotes, c, '"', "\t")
    return out


def least_edits(line, columns):
    """Brute force: all ways to edit as few quotes as possible, then to fill the columns by joining or adding fields."""
    lines = {line}
    for q in range(len(line) + 2):
        well = [f for x in lines if (f := EP.strict_fields(x)) is not None]
        if well:
            break
        lines = {x[:i] + '"' + x[i:] for x in lines for i in range(len(x) + 1)} | {x[:i] + x[i + 1 :] for x in lines for i, c in enumerate(x) if c == '"'}
    m, best = len(columns), None
    for f in well:
        n = len(f)
        if n >= m:
            ways = [["".join(f[a:b]) for a, b in zip((0, *at), (*at, n))] for at in itertools.combinations(range(1, n), m - 1)]
        else:
            ways = []
            for x in lines:
                if EP.strict_fields(x) == f:
                    atoms = [[t] if raw.startswith('"') else EP._symbols(t, '"', "\t") for t, raw in zip(f, raw_fields(x))]
                    spots = [(k, i) for k, a in enumerate(atoms) for i in range(len(a) + 1)]
                    for chosen in itertools.combinations_with_replacement(spots, m - n):
                        out = []
                        for k, a in enumerate(atoms):
                            at = [0, *(i for j, i in chosen if j == k), len(a)]
                            out += ["".join(a[y:z]) for y, z in zip(at, at[1:])]
                        ways.append(out)
        for w in ways:
            bad = 0
            for t, c in zip(w, columns):
                bad += not c.good(c.after(c.first, t) if t else c.first)
            best = min(filter(None, (best, (abs(n - m), bad))))
    return (q, *best)


@settings(max_examples=600, deadline=None)
@given(st.text('"\t1a', max_size=7))
@example('"1"""')
@example('"1" "')
def test_parse_is_cheapest(line):
    columns = (EP.Digits(), EP.Some(), EP.OneOf(["a", "aa"]))
    cost, edits = EP.cheapest_parse(line, columns)
    assert cost == least_edits(line, columns) and len(edits) == sum(cost)


TAGS = frozenset(["NN", "``", "''"])


@pytest.mark.parametrize(
    "line, reason, cost",
    [
        ("a/NN ``/`` b/NN ''/''", None, 0), ("''/''", "quoting", 1), ("``/``", "quoting", 1), ("''/'' ``/``", "quoting", 2), ("``/`` ``/`` ''/''", "quoting", 1),
        ("``/XX", "quoting", 1), ("``/XX a/NN", "quoting", 1), ("aNN b", "columns", 3), ("a/XX /NN", "value", 2), ("aNN ``/``", "quoting", 2), ("", None, 0),
    ],
)
def test_tagged_reasons(line, reason, cost):
    fields, got, n, edits = EP.parse_tagged(line, TAGS)
    assert (got, n, len(edits)) == (reason, cost, cost) and (fields is None) == (reason is not None)


def test_long_lines_parse():
    assert EP.parse_delimited("\t" * 5000)[1:3] == ("columns", 4992 + 7)
    assert EP.parse_delimited("x" * 100_000)[1] == "columns"


def test_parse_tables(spark):
    rows = [(1, GOOD, "k"), (2, None, "k"), (3, " \t", "k"), (4, GOOD + "\tx", None), (4, GOOD + "\tx", None), (5, '"' + "x" * 20000, "k"), (6, "\n", "k")]
    df = spark.createDataFrame(rows, "line_id long, toks string, reason string").repartition(3)
    got = sorted((r.line_id, r.reason) for r in EP.parse_ner_lines(df, "line_id", "toks").select("line_id", "reason").collect())
    assert got == [(1, None), (4, "columns"), (4, "columns"), (5, "quoting"), (6, "columns")] or sorted(map(str, got)) == sorted(map(str, [(1, None), (4, "columns"), (4, "columns"), (5, "quoting"), (6, "columns")]))
    tags = ["DT", "NN", "``", "''"]
    lines = [(1, "a/DT  b/c/NN"), (2, "a/DT b"), (3, "``/`` a/DT"), (4, "a/XX"), (5, "/DT"), (6, "``/`` a/DT ''/''"), (7, ""), (8, None), (9, "``/`` b")]
    t = spark.createDataFrame(lines, "line_id long, line string")
    assert {r.line_id: r.reason for r in EP.parse_tagged_lines(t, "line_id", "line", tags).collect()} == {1: None, 2: "columns", 3: "quoting", 4: "value", 5: "value", 6: None, 9: "quoting"}
    assert EP.parse_ner_lines(df.limit(0), "line_id", "toks").count() == 0


def test_title_and_upper(spark):
    words = ["Abc", "ABC", "aBc", "A", "a", "McDonald", "Mc-Donald", "1A", "A1b", "É", "3", "", "O'Neil", "Ab Cd", "-x"]
    got = {r.w: (r.t, r.u) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.is_title(F.col("w")).alias("t"), T.is_upper(F.col("w")).alias("u")).collect()}
    assert got == {w: (w.istitle(), w.isupper()) for w in words}


def test_acyclic(spark):
    r = random.Random(1)
    rows, want = [], {}
    for s in range(200):
        n = r.randint(1, 8)
        heads = [r.randint(0, n) for _ in range(n)]
        rows += [(s, i + 1, h, "x") for i, h in enumerate(heads)]
        want[s] = (reaches_root(heads), heads.count(0) == 1)
    got = {r.sent_id: (r.acyclic, r.connected) for r in acyclic(spark.createDataFrame(rows, "sent_id long, idx int, head int, rel string")).collect()}
    assert got == want


def chunk_set(spark, tags):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "sent_id long, pos int, gold string")
    return sorted((r.start, r.end, r.type) for r in M.chunks(df, "gold").collect())


@pytest.mark.parametrize(
    "tags, want",
    [
        (["B-X", "I-X", "O"], [(0, 1, "X")]), (["I-X", "I-X"], [(0, 1, "X")]), (["I-X", "B-X"], [(0, 0, "X"), (1, 1, "X")]), (["I-X", "I-Y"], [(0, 0, "X"), (1, 1, "Y")]),
        (["O", "B-X", "B-X"], [(1, 1, "X"), (2, 2, "X")]), (["E-X", "I-X", "E-X"], [(0, 0, "X"), (1, 2, "X")]), (["O", "O"], []), (["B-a-b", "I-a-b"], [(0, 1, "a-b")]),
    ],
)
def test_chunk_rules(spark, tags, want):
    assert chunk_set(spark, tags) == want


def test_corpus_helpers(spark):
    s = spark.createDataFrame([(1, " a b  c "), (2, "a a"), (3, None), (4, "")], "id long, line string")
    sents = C.sentences(s, "id", "line")
    t = C.tokens(sents)
    freq = {r.word: r.freq for r in C.frequencies(t).collect()}
    assert freq == {"a": 3, "b": 1, "": 2, "c": 1}
    assert [(r.id, r.word) for r in C.ranked(C.frequencies(t)).orderBy("id").collect()] == [(0, "a"), (1, ""), (2, "b"), (3, "c")]
    assert {r.sent_id: r.line for r in C.reassembled(C.replace_rare(t, C.frequencies(t), 1)).collect()} == {1: "a *unk*  *unk*", 2: "a a", 4: ""}
    assert sorted(r.sent_id for r in C.length_between(sents, 1, 4).collect()) == [2]


def sequential(rows, tags, epochs):
    """The algorithm on plain dictionaries: one pass per epoch in order of sentences, means of the weights after each epoch."""
    w, kept, order = defaultdict(lambda: np.zeros(len(tags))), [], sorted(rows, key=lambda r: r.sent_id)
    for _ in range(epochs):
        for r in order:
            e = np.array([sum((v * w[f] for f, v in zip(fs, vs)), np.zeros(len(tags))) for fs, vs in zip(r.feats, r.vals)])
            pred = best_path(w["\x01init"], np.array([w[f"\x01prev:{j}"] for j in range(len(tags))]).T, w["\x01final"], e[None])[0][0]
            gold = [tags.index(t) for t in r.tags]
            if list(pred) != gold:
                for y, by in ((gold, 1), (pred, -1)):
                    w["\x01init"][y[0]] += by
                    w["\x01final"][y[-1]] += by
                    for i in range(len(y)):
                        if i:
                            w[f"\x01prev:{y[i - 1]}"][y[i]] += by
                        if gold[i] != pred[i]:
                            for f, v in zip(r.feats[i], r.vals[i]):
                                w[f][y[i]] += by * v
        kept.append({k: v.copy() for k, v in w.items()})
    return {k: sum(x.get(k, 0) for x in kept) / epochs for k in w}


def test_perceptron_is_the_sequential_one(spark):
    r = random.Random(2)
    toks = [(s, p, r.choice(["Bob", "runs", "Rome", "the"]), r.choice(["O", "B-PER"])) for s in range(25) for p in range(r.randint(1, 6))]
    sent = PC.as_sentences(FT.emission(FT.windowed(spark.createDataFrame(toks, "sent_id long, pos int, word string, tag string"))))
    tags = ["B-PER", "O"]
    want = sequential(sent.collect(), tags, 3)
    got = {x.name: x.w for x in PC.train(sent, tags, 3, 1).collect()}
    assert all(np.allclose(got[k], want.get(k, 0)) for k in got) and all(k in got or not np.any(v) for k, v in want.items())


def test_perceptron(spark):
    r, rows = random.Random(0), []
    for s in range(60):
        for i in range(r.randint(1, 6)):
            w = r.choice("abcd")
            rows.append((s, i, w, {"a": "B-X", "b": "I-X"}.get(w, "O")))
    toks = spark.createDataFrame(rows, "sent_id long, pos int, word string, tag string")
    sent = PC.as_sentences(FT.emission(FT.windowed(toks)))
    tags = ["B-X", "I-X", "O"]
    for shards in (1, 3):
        got = PC.predict(sent, PC.train(sent, tags, 3, shards), tags)
        assert got.where("gold <> pred").count() == 0 and got.count() == len(rows)


def test_plugins(spark, tmp_path):
    from latentia.sources import plugins

    plugins.register(spark)
    (tmp_path / "a").write_text("\n" + SENT + "\n" + SENT.replace("cat", "dog"))
    (tmp_path / "b").write_text("1\tA\ta\tD\tDT\t_\t0\tROOT\n")
    got = spark.read.format("conll").load(str(tmp_path))
    assert sorted((r.sent_id, r.idx, r.form, r.head) for r in got.collect()) == [(1, 1, "A", 0), (1, 1, "The", 2), (1, 2, "cat", 0), (2, 1, "The", 2), (2, 2, "dog", 0)]
    rows = spark.sql("select t.pos, t.word from values (' a  b ') s(line), lateral tokenize(line) t").collect()
    assert sorted((r.pos, r.word) for r in rows) == [(0, "a"), (1, ""), (2, "b")]


def test_indexes_and_listing(spark, tmp_path):
    for n in ("p10.conll", "p2.conll", "note.txt"):
        (tmp_path / n).write_text("x")
    got = R.parsed_index(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.file_no, r.position) for r in got] == [(2, 1), (10, 2)]
    assert R.listing(spark, str(tmp_path), "note").count() == 1


def test_several_files_are_one_corpus(spark, tmp_path):
    src = tmp_path / "c"
    src.mkdir()
    (src / "a.txt").write_text("a b c\nd e\n")
    (src / "b.txt").write_text("x y z\nw v\n")
    t = C.reassembled(C.tokens(R.text_corpus(spark, str(src))))
    assert sorted((r.sent_id, r.line) for r in t.collect()) == [(1, "a b c"), (2, "d e"), (3, "x y z"), (4, "w v")]
    trees = tmp_path / "t"
    trees.mkdir()
    (trees / "1.conll").write_text(SENT + "\n\n\n" + SENT.replace("cat", "dog"))
    (trees / "2.conll").write_text("\n" + SENT.replace("cat", "cow") + "\n")
    got = [(r.sent_id, r.idx, r.form) for r in R.conll_corpus(spark, str(trees)).orderBy("sent_id", "idx").collect()]
    assert got == [(1, 1, "The"), (1, 2, "cat"), (2, 1, "The"), (2, 2, "dog"), (3, 1, "The"), (3, 2, "cow")]


@pytest.mark.parametrize("parts", ["1", "2", "7"])
def test_sentences_across_ranges(spark, parts):
    r = random.Random(5)
    lines = [(f"f{r.randint(0, 2)}", i, r.choice(["", "a", "b"])) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.createDataFrame(lines, "file string, line_no long, line string")
        got = {(x.file, x.line_no): x.sent_id for x in R.sentences(rows, F.col("line") == "").collect()}
        marks = {(x.file, x.line_no): x.sent_id for x in R.sentences(rows, F.col("line") == "", marks=F.col("line_no") % 2 == 0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, heads, n, last, inside = {}, {}, 0, None, False
    for f, i, t in sorted(lines):
        inside = inside and f == last
        if t:
            n += not inside
            want[f, i] = n
        elif i % 2 == 0:
            heads[f, i] = n + 1
        inside, last = bool(t), f
    assert got == want and marks == heads


def test_embedding_cells_must_be_numbers(spark, tmp_path):
    (tmp_path / "e").write_text("a 1 2\nb 1 x\n")
    with pytest.raises(Exception, match="no number"):
        R.embeddings(spark, str(tmp_path / "e")).collect()
