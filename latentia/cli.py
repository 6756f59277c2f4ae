"""Command line: train, normalize, ner, posteriors, map. Runs in the session that spark-submit or Python gives it."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession, Window, functions as F

from latentia.operators import corpus as C, decode as D, em as E, introspect as I, ner as N, params as P
from latentia.plans.rep_queries import TAGS
from latentia.sources import readers as R, writers as W

RELATION_LIMIT = 10_000
log = logging.getLogger("latentia")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latentia", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="train a model on a text or dependency corpus")
    t.add_argument("--dataset", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--tree", action="store_true")
    t.add_argument("--rel", action="store_true")
    t.add_argument("--rel_spec", nargs="*", default=None, help="relations that keep parameters of their own")
    t.add_argument("--lr", action="store_true", help="relations are the sides of the head")
    t.add_argument("--start_n_states", type=int, default=30)
    t.add_argument("--desired_n_states", type=int, default=None, help="split (and merge) until so many")
    t.add_argument("--max_iter", type=int, default=5)
    t.add_argument("--minibatch_size", type=int, default=1000, help="sequences of a step of online training, the default")
    t.add_argument("--a", type=float, default=4)
    t.add_argument("--alpha", type=float, default=0.5)
    t.add_argument("--permute", type=int, default=0, help="seed of the mini-batches' order; -1: as the corpus is")
    t.add_argument("--noise_amount", type=float, default=0.01)
    t.add_argument("--sensitivity", type=float, default=0.5)
    t.add_argument("--approx", action="store_true")
    t.add_argument("--brown_init_path", default=None)
    t.add_argument("--omit_class_cond", action="store_true")
    t.add_argument("--omit_emis_cond", action="store_true")
    t.add_argument("--params_trained", default=None, help="start from written parameters")
    t.add_argument("--howbig", type=int, default=None)
    t.add_argument("--seed", type=int, default=0)
    t.add_argument("--full_batch", action="store_true", help="batch training")
    t.add_argument("--lemmas", action=argparse.BooleanOptionalAction, default=True, help="trees over lemmas or over forms")
    t.add_argument("--append_string", default="", help="is appended to the output folder's name")
    t.add_argument("--no_writeout", action="store_true", help="write neither parameters nor vocabulary")
    t.add_argument("--log", default=None, help="file for the driver's log")
    n = sub.add_parser("normalize", help="replace rare words, filter by length")
    n.add_argument("--dataset", required=True)
    n.add_argument("--output", required=True)
    n.add_argument("--conll", action="store_true")
    n.add_argument("--lemmas", action="store_true")
    n.add_argument("--freq_thresh", type=int, default=1)
    n.add_argument("--min_len", type=int, default=4)
    n.add_argument("--max_len", type=int, default=40)
    e = sub.add_parser("ner", help="train and score an entity tagger")
    e.add_argument("--train", default=None)
    e.add_argument("--test", required=True)
    e.add_argument("--lang", choices=("en", "nl"), default="en")
    e.add_argument("--output_dir", required=True)
    e.add_argument("--rep_path", default=None, help="folder of trained parameters and vocabulary")
    e.add_argument("--decoding", default="posterior_cont")
    e.add_argument("--brown_cluster_file", default=None)
    e.add_argument("--embed", default=None)
    e.add_argument("--n_epochs", type=int, default=2)
    e.add_argument("--use_muc", action="store_true")
    e.add_argument("--train_parsed", default=None, help="CoNLL parses of the training sentences, in their order")
    e.add_argument("--test_parsed", default=None)
    e.add_argument("--train_parsed_files", default=None, help="folder of files numbered by the sentences that have a parse")
    e.add_argument("--test_parsed_files", default=None)
    e.add_argument("--rel_spec", nargs="*", default=None, help="relations that keep parameters of their own")
    e.add_argument("--lr", action="store_true")
    e.add_argument("--ignore_rel", default=None, help="nodes of this relation get no representation")
    e.add_argument("--embed_v", default=None, help="vocabulary that restricts the embeddings")
    e.add_argument("--weights", default=None, help="use these weights, train nothing")
    e.add_argument("--weights_out", default=None)
    d = sub.add_parser("posteriors", help="in-context or type posteriors of a corpus")
    d.add_argument("--rep", required=True)
    d.add_argument("--infile", required=True)
    d.add_argument("--outfile", required=True)
    d.add_argument("--types", action="store_true")
    d.add_argument("--tree", action="store_true", help="the input is a dependency corpus")
    d.add_argument("--use_lemmas", action="store_true")
    d.add_argument("--synfunc", action="store_true", help="types by word and relation")
    m = sub.add_parser("map", help="two-dimensional map of target words")
    m.add_argument("--vectors", required=True)
    m.add_argument("--targets", required=True)
    m.add_argument("--incontext_file", default=None, help="token vectors that are laid out beside the types")
    m.add_argument("--outfile", required=True)
    return top


def set_up_logging(path: str | None) -> None:
    """The driver's messages go to a file as well; executors log by Spark's own settings."""
    log.setLevel(logging.INFO)
    if path:
        handler = logging.FileHandler(path)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)


def _corpus(spark: SparkSession, a) -> tuple:
    """Sequences or trees, the vocabulary, and the relation names in use."""
    if not a.tree and not a.rel:
        toks = C.tokens(R.text_corpus(spark, a.dataset, a.howbig))
        vocab = C.ranked(C.frequencies(toks))
        return E.as_sequences(toks.join(vocab.select("word", F.col("id").alias("word_id")), "word")), vocab, []
    nodes = _renamed(R.conll_corpus(spark, a.dataset, a.howbig), a)
    vocab = C.ranked(C.frequencies(nodes))
    names = []
    if a.rel:
        names = sorted(r.rel for r in nodes.select("rel").distinct().limit(RELATION_LIMIT + 1).collect())
        if len(names) > RELATION_LIMIT:
            raise ValueError(f"more than {RELATION_LIMIT} relations: name those that keep parameters of their own")
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("rel")) - 1 if names else F.lit(0)
    nodes = nodes.withColumn("r", number.cast("int")).join(vocab.select("word", F.col("id").alias("word_id")), "word")
    return E.as_trees(nodes, "word_id", "r"), vocab, names


def _renamed(nodes, a):
    """Words by lemma or form, relations as the model has them."""
    nodes = nodes.withColumn("word", F.col("lemma") if getattr(a, "lemmas", True) else F.col("form"))
    rel = F.when(F.col("head") > F.col("idx"), "left").otherwise("right") if a.lr else F.when(F.col("rel").isin(*a.rel_spec), F.col("rel")).otherwise("OTHER") if a.rel_spec else F.col("rel")
    return nodes.withColumn("rel", rel)


def _trained(spark: SparkSession, folder: str):
    """Final parameters, vocabulary and relation names of a training's output."""
    names = R.settings_of(spark, folder).get("relations", "")
    return P.from_table(R.parameters(spark, f"{folder}/params")), spark.read.parquet(f"{folder}/vocab"), names.split("\t") if names else []


def train(spark: SparkSession, a) -> P.Params:
    set_up_logging(a.log)
    data, vocab, names = _corpus(spark, a)
    out = a.output + a.append_string
    m, r = vocab.count(), max(1, len(names))
    if a.params_trained:
        p = P.from_table(R.parameters(spark, a.params_trained))
    else:
        p = P.random_params(a.start_n_states, m, r, a.seed, a.omit_class_cond, a.omit_emis_cond)
        if a.brown_init_path:
            for row in P.brown_emission(vocab, R.brown(spark, a.brown_init_path)).toLocalIterator():
                p.E[row.word_id, row.state] = row.v
    if not p.sane():
        raise ValueError("initial parameters do not sum to one")
    log.info("%d states, %d words, %d relations", p.n, m, r)
    keep = (lambda q, stage: None) if a.no_writeout else lambda q, stage: W.params(q, spark, f"{out}/params", stage)
    keep(p, "initial")
    online = {} if a.full_batch else {"batch_size": a.minibatch_size, "a": a.a, "alpha": a.alpha, "order": None if a.permute < 0 else a.permute}
    if a.desired_n_states:
        p, steps = E.split_merge_em(data, p, a.desired_n_states, a.max_iter, a.noise_amount, a.sensitivity, seed=a.seed, keep=keep, **online)
        lls = [ll for _, ll in steps]
    elif online:
        p, lls = E.online_em(data, p, a.max_iter, a.minibatch_size, a.a, a.alpha, a.approx, online["order"])
    else:
        p, lls = E.em(data, p, a.max_iter, a.approx)
    for i, ll in enumerate(lls):
        log.info("step %d: log-likelihood %.4f", i, ll)
    keep(p, "final")
    if not a.no_writeout:
        vocab.write.mode("overwrite").parquet(f"{out}/vocab")
        W.settings(spark, vars(a) | {"N": p.n, "M": m, "R": r, "relations": "\t".join(names)}, lls, out)
    return p


def normalize(spark: SparkSession, a) -> None:
    if a.conll:
        word = "lemma" if a.lemmas else "form"
        nodes = R.conll_corpus(spark, a.dataset)
        sizes = nodes.groupBy("sent_id").agg(F.count("*").alias("n")).where((F.col("n") > a.min_len) & (F.col("n") < a.max_len)).select("sent_id")
        counts = nodes.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("freq"))
        W.conll(C.replace_rare(nodes.join(sizes, "sent_id", "left_semi"), counts, a.freq_thresh, word=word), a.output)
    else:
        toks = C.tokens(R.text_corpus(spark, a.dataset))
        W.sentences(C.reassembled(C.replace_rare(toks, C.frequencies(toks), a.freq_thresh)), a.output)


def ner(spark: SparkSession, a) -> None:
    read = R.ner2003 if a.lang == "en" else R.ner2002
    if a.train is None and a.weights is None:
        raise ValueError("either --train or --weights is needed")
    chosen = dict(N.LANGUAGES[a.lang])
    if a.brown_cluster_file:
        chosen["brown"] = R.brown(spark, a.brown_cluster_file)
    vectors = R.embeddings(spark, a.embed, R.vocabulary(spark, a.embed_v) if a.embed_v else None) if a.embed else None
    model = _trained(spark, a.rep_path) if a.rep_path and not a.embed else None

    def prepared(path: str | None, parsed: str | None, files: str | None):
        if path is None:
            return None
        toks = read(spark, path).drop("file")
        if vectors is not None:
            return N.embedded(toks, vectors)
        if model is None:
            return toks
        p, vocab, names = model
        if parsed is None:
            return N.represented(toks, vocab, p, a.decoding)
        parses = _renamed(R.conll_corpus(spark, parsed).drop("file"), a)
        if files is not None:
            parses = N.with_parses(toks, parses, R.parsed_index(spark, files))
        return N.tree_represented(toks, parses, vocab, p, a.decoding, names, a.ignore_rel)

    sets = [prepared(a.train, a.train_parsed, a.train_parsed_files), prepared(a.test, a.test_parsed, a.test_parsed_files)]
    if vectors is not None or model is not None:
        chosen["rep"] = "rep" if vectors is not None or "cont" in a.decoding else "state"
        chosen["rep_name"] = "tree" if a.test_parsed and vectors is None else "rep"
    weights = R.weights(spark, a.weights) if a.weights else None
    keep = (lambda w: W.weights(w, a.weights_out)) if a.weights_out else None
    pred, scores = N.experiment(*sets, TAGS, a.n_epochs, weights=weights, keep=keep, **chosen)
    W.predictions(pred.join(sets[1].select("sent_id", "pos", "word"), ["sent_id", "pos"]), f"{a.output_dir}/predictions", muc=a.use_muc)
    scores.coalesce(1).write.mode("overwrite").json(f"{a.output_dir}/scores")


def posteriors(spark: SparkSession, a) -> None:
    p, vocab, names = _trained(spark, a.rep)
    if a.tree:
        nodes = R.conll_corpus(spark, a.infile).withColumn("word", F.col("lemma") if a.use_lemmas else F.col("form"))
        toks = nodes.select("sent_id", (F.col("idx") - 1).alias("pos"), "word")
        if not a.types:
            W.token_representations(N.tree_represented(toks, nodes, vocab, p, relations=names).where("rep is not null"), a.outfile)
            return
        number = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("rel")) - 1, F.lit(0)) if names else F.lit(0)
        ids = N.word_ids(nodes.select("sent_id", "idx", "head", "rel", "word"), vocab).withColumn("r", F.greatest(number, F.lit(0)).cast("int"))
        rows = D.type_posteriors(E.as_trees(ids.where("word_id is not null"), "word_id", "r"), p, by_rel=a.synfunc)
        if a.synfunc:
            rows = rows.withColumn("rel", F.element_at(F.array(*[F.lit(x) for x in names or ["*"]]), F.col("rel") + 1))
        W.type_representations(rows.join(vocab.select(F.col("id").alias("word_id"), "word"), "word_id"), a.outfile)
        return
    toks = C.tokens(R.text_corpus(spark, a.infile))
    if a.types:
        data = E.as_sequences(N.word_ids(toks, vocab).where("word_id is not null"))
        rows = D.type_posteriors(data, p).join(vocab.select(F.col("id").alias("word_id"), "word"), "word_id")
        W.type_representations(rows, a.outfile)
    else:
        W.token_representations(N.represented(toks, vocab, p).where("rep is not null"), a.outfile)


def planar_map(spark: SparkSession, a) -> None:
    names = spark.read.text(a.targets).select(F.col("value").alias("word")).distinct()
    rows = R.with_in_context(R.embeddings(spark, a.vectors, names), spark, a.incontext_file)
    numbered = rows.withColumn("word_id", F.row_number().over(Window.orderBy("word", "rep")).cast("long"))  # a target list
    v = numbered.select("word_id", F.col("rep").alias("v"))
    W.planar_map(I.planar_map(v, v), a.outfile)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"latentia {a.command}").getOrCreate()
    {"train": train, "normalize": normalize, "ner": ner, "posteriors": posteriors, "map": planar_map}[a.command](spark, a)


if __name__ == "__main__":
    main()
