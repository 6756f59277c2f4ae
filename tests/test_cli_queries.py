"""The command line end to end, and every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from latentia import cli
from latentia.plans import registry

CONLL = "1\tThe\tthe\tD\tDT\t_\t2\tNMOD\t_\t_\n2\tcat\tcat\tN\tNN\t_\t3\tSBJ\t_\t_\n3\truns\trun\tV\tVB\t_\t0\tROOT\t_\t_\n\n"


def test_train_normalize_posteriors(spark, tmp_path):
    text = tmp_path / "text"
    text.write_text("\n".join(["the cat runs", "a dog runs far", "the dog sleeps"] * 20))
    run = lambda name, args: {"train": cli.train, "normalize": cli.normalize, "posteriors": cli.posteriors, "ner": cli.ner}[name](spark, cli.parser().parse_args([name, *args]))
    p = run("train", ["--dataset", str(text), "--output", str(tmp_path / "m"), "--start_n_states", "3", "--max_iter", "2"])
    assert p.sane(1e-6) and p.n == 3
    assert spark.read.json(str(tmp_path / "m/settings")).first().settings["N"] == "3"
    run("normalize", ["--dataset", str(text), "--output", str(tmp_path / "n"), "--freq_thresh", "20"])
    assert {r.value for r in spark.read.text(str(tmp_path / "n")).collect()} == {"the *unk* runs", "*unk* dog runs *unk*", "the dog *unk*"}
    run("posteriors", ["--rep", str(tmp_path / "m"), "--infile", str(text), "--outfile", str(tmp_path / "p"), "--types"])
    assert spark.read.text(str(tmp_path / "p")).count() == 7
    trees = tmp_path / "trees"
    trees.write_text(CONLL * 15)
    p = run("train", ["--dataset", str(trees), "--output", str(tmp_path / "t"), "--rel", "--rel_spec", "SBJ", "--start_n_states", "2", "--max_iter", "2"])
    assert p.sane(1e-6) and p.r == 2
    ner = tmp_path / "ner"
    ner.write_text("".join("O\t0\t0\tX\tDT\tthe\tx\tx\t0\nB-PER\t0\t1\tX\tNN\tdog\tx\tx\t0\n\n" for _ in range(10)))
    run("ner", ["--train", str(ner), "--test", str(ner), "--output_dir", str(tmp_path / "o"), "--rep_path", str(tmp_path / "m"), "--decoding", "viterbi"])
    scores = {r["type"]: r.fb1 for r in spark.read.json(str(tmp_path / "o/scores")).collect()}
    assert scores["PER"] == 100


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(pdf):
    def value(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x != x:
            return "-"
        return f"{round(x, 5) + 0.0}" if isinstance(x, float) else str(x)

    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(value(x) for x in r) for r in pdf.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = rows(registry.QUERIES[name](spark, sf_dir).toPandas())
    assert got == rows(duck.execute(registry.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ner_with_parses_and_saved_weights(spark, tmp_path):
    """Representations from parses of some sentences, weights written and used again, split stages and the log."""
    run = lambda name, args: {"train": cli.train, "ner": cli.ner, "posteriors": cli.posteriors}[name](spark, cli.parser().parse_args([name, *args]))
    trees = tmp_path / "trees"
    trees.mkdir()
    for k in range(2):
        (trees / f"{k}.conll").write_text(CONLL * 8)
    out = tmp_path / "m"
    run("train", ["--dataset", str(trees), "--output", str(out), "--rel", "--rel_spec", "SBJ", "--start_n_states", "2", "--desired_n_states", "4", "--max_iter", "1", "--log", str(tmp_path / "log"), "--append_string", "_x"])
    out = tmp_path / "m_x"
    assert {p.name for p in (out / "params").iterdir() if p.is_dir()} == {"stage=initial", "stage=split1", "stage=final"}
    assert "log-likelihood" in (tmp_path / "log").read_text()
    again = run("train", ["--dataset", str(trees), "--output", str(tmp_path / "n"), "--rel", "--rel_spec", "SBJ", "--params_trained", str(out / "params"), "--max_iter", "1"])
    assert again.n == 4 and again.r == 2
    nl = tmp_path / "nl"
    nl.write_text("-DOCSTART- x O\n" + "the D O\ncat N B-PER\nruns V O\n\n" * 6)
    parsed = tmp_path / "parsed"
    parsed.write_text(CONLL.replace("The", "the") * 4)
    files = tmp_path / "files"
    files.mkdir()
    for k in (1, 2, 4, 6):  # sentences 3 and 5 could not be parsed
        (files / f"{k}.tab").write_text("x")
    args = ["--test", str(nl), "--test_parsed", str(parsed), "--test_parsed_files", str(files), "--lang", "nl", "--rep_path", str(out), "--rel_spec", "SBJ", "--ignore_rel", "SBJ"]
    run("ner", ["--train", str(nl), "--train_parsed", str(parsed), "--train_parsed_files", str(files), "--output_dir", str(tmp_path / "a"), "--weights_out", str(tmp_path / "w"), *args])
    run("ner", ["--weights", str(tmp_path / "w"), "--output_dir", str(tmp_path / "b"), *args])
    read = lambda k: sorted(r.value for r in spark.read.text(str(tmp_path / k / "predictions")).collect())
    assert read("a") == read("b") and len(read("a")) == 24
    run("posteriors", ["--rep", str(out), "--infile", str(trees), "--outfile", str(tmp_path / "t"), "--types", "--tree", "--use_lemmas", "--synfunc"])
    keys = {r.value.split(" ")[0] for r in spark.read.text(str(tmp_path / "t")).collect()}
    assert keys == {"the+OTHER", "cat+SBJ", "run+OTHER"} or keys == {"the+OTHER", "cat+SBJ", "run+OTHER", "cat+OTHER"}
