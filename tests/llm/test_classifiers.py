import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, toxicity
from tessera.llm.common import id_remainder, sample_ids

FILLER = "the of and in ring river stone table lamp house green walk".split()


def text_of(rng, n, extra=()):
    return " ".join([*rng.choice(FILLER, n), *extra])


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        # Neither word tells by itself: insult and group are toxic together only.
        extra = ("insultish", "groupish") if toxic else (("insultish",), ("groupish",), ())[k % 3]
        docs.append((k, text_of(rng, 20, extra)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_pairwise_interactions_are_learned(spark, toxic_rows):
    docs, labels = (spark.createDataFrame(r, s) for r, s in zip(toxic_rows, ("doc_id long, text string", "doc_id long, toxic int"), strict=True))
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held_out)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).filter(held_out).collect()}
    assert np.mean([got[k]["predicted"] == t for k, t in toxic_rows[1] if k in got]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    alone = [got[k]["predicted"] for k, t in toxic_rows[1] if k in got and not t]
    assert np.mean(alone) < 0.05  # a third of these hold the insult, a third the group: neither by itself is toxic


def test_margins_equal_the_pairwise_sum():
    rng = np.random.default_rng(1)
    fm = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    docs = [[0, 2, 5], [], [4], [1, 3], []]
    want = [0.3 + sum(fm.w[d]) + sum(fm.v[a] @ fm.v[b] for i, a in enumerate(d) for b in d[:i]) for d in docs]
    lens = np.array([len(d) for d in docs])
    got = fm.margins(np.array([x for d in docs for x in d], dtype=np.int64), np.concatenate(([0], np.cumsum(lens)[:-1])))
    assert np.allclose(got, want)


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, score string, predicted string"
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "x " * 50_000, "a", "b"), (3, "x " * 50_000, "a", "b"), (None, "hm", None, None)]
    docs = spark.createDataFrame(rows, schema)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, empty, F.lit(True))
    got = toxicity.score(docs, model)
    assert got.dtypes == [("doc_id", "bigint"), ("text", "string"), ("score", "double"), ("predicted", "int")]
    assert [r["predicted"] for r in got.collect()] == [0] * 5
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    only_one_class = toxicity.train(docs, odd, F.lit(True))
    assert toxicity.score(docs.limit(0), only_one_class).count() == 0


def test_sample_is_bounded_and_exact_for_small_classes(spark):
    df = spark.range(3000).select("id", (F.col("id") % 100 == 0).cast("int").alias("class"))
    got = {r["class"]: r["count"] for r in sample_ids(df, 100).groupBy("class").count().collect()}
    assert got == {0: 100, 1: 30}
    assert sample_ids(df.limit(0), 100).count() == 0


def test_an_id_that_repeats_neither_fills_the_sample_nor_empties_it(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 10_000, 5).otherwise(F.col("id")).alias("id"), (F.col("id") % 2).alias("class"))
    rare = spark.range(10_000).select(F.lit(7).cast("long").alias("id"), F.lit(2).cast("long").alias("class"))
    few = spark.range(10_000).select((F.col("id") % 90).alias("id"), F.lit(3).cast("long").alias("class"))
    got = sample_ids(df.union(rare).union(few), 64).collect()
    assert len(set(got)) == len(got)
    assert {c: sum(r["class"] == c for r in got) for c in range(4)} == {0: 64, 1: 64, 2: 1, 3: 64}


def test_repeated_ids_lose_no_class(spark):
    """Rows that repeat an id count once in training, and the choice among them is defined."""
    many = spark.range(10_000).selectExpr("5L AS doc_id", "concat('zwei drei ', id) AS text", "'de' AS lang")
    more = spark.range(70).selectExpr("id + 100 AS doc_id", "'lorem ipsum dolor' AS text", "'la' AS lang")
    model = language.train(many.union(more), F.lit(True))
    assert model.names == ["de", "la"] and model.automata[0].letters < 20
    assert language.parse(["drei zwei", "ipsum lorem"], model)[0] == ["de", "la"]
    docs = spark.range(10_000).selectExpr("5L AS doc_id", "concat('bad bad ', id) AS text").union(spark.range(80).selectExpr("id + 100 AS doc_id", "concat('good ', id) AS text"))
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id = 5 AS int) AS toxic")
    assert toxicity.train(docs, labels, F.lit(True)).w0 < 0


def test_an_interaction_among_noise_is_found():
    """Neither term tells anything by itself, and 4,000 others are there."""
    rng = np.random.default_rng(0)
    documents, labels = [], []
    for _ in range(2000):
        insult, group = rng.random(2) < 0.5
        documents.append(np.unique(np.concatenate([rng.integers(0, 4000, 25), np.array([5000, 5001])[[insult, group]]])))
        labels.append(int(insult == group))
    labels = np.array(labels)
    fm = toxicity.fit(documents[:1600], labels[:1600], 0.5)
    rows = [np.searchsorted(fm.terms, d[np.isin(d, fm.terms)]) for d in documents[1600:]]
    lens = np.array([len(r) for r in rows])
    found = fm.margins(np.concatenate(rows), np.cumsum(lens) - lens) >= 0
    assert (found == labels[1600:]).mean() >= 0.97


LANGS = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit".split(), "bb": "zwei drei vier funf sechs sieben acht neun zehn".split()}


def brute_phrases(text, known):
    """Greedy longest matches against the learned text, without an automaton."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


class Substrings:
    def __init__(self, text):
        self.found = {text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)}

    def __contains__(self, part):
        return part in self.found


@pytest.mark.parametrize("symbols", [3, 40])
def test_automaton_accepts_exactly_the_substrings(symbols):
    rng = np.random.default_rng(3)
    text = rng.integers(0, symbols, 60).astype(np.int32)
    machine, known = language.automaton(text, symbols), Substrings(tuple(text.tolist()))

    def accepted(word):
        s = np.array([0])
        for c in word:
            s = machine.follow(s, np.array([c]))
            if s[0] < 0:
                return False
        return True

    words = [tuple(rng.integers(0, symbols, rng.integers(1, 9)).tolist()) for _ in range(400)]
    words += [tuple(text[a : a + n].tolist()) for a in range(0, 50, 5) for n in (1, 4, 10)]
    assert [accepted(w) for w in words] == [w in known for w in words]


@pytest.mark.parametrize("stride", [4, 16, 1024])
def test_whole_texts_are_parsed_from_their_first_letter_on(monkeypatch, stride):
    monkeypatch.setattr(language, "STRIDE", stride)
    monkeypatch.setattr(language, "LEAD", min(stride, 3))
    rng = np.random.default_rng(6)
    for symbols in (2, 5, 30):
        text = rng.integers(0, symbols, 90).astype(np.int32)
        machine, known = language.automaton(text, symbols + 3), Substrings(tuple(text.tolist()))
        rows = [rng.integers(0, symbols + 2, n).astype(np.int32) for n in (0, 1, 17, 120, 121)]
        rows += [np.full(100, text[0], np.int32), np.concatenate([text, text, text[:30]]), np.full(70, symbols + 1, np.int32)]
        assert language.phrase_counts(rows, machine).tolist() == [brute_phrases(tuple(r.tolist()), known) for r in rows]


def test_parse_equals_a_parser_without_automata():
    rng = np.random.default_rng(9)
    model = language.learn({lang: [" ".join(rng.choice(words, 25))] for lang, words in LANGS.items()})
    again = np.random.default_rng(9)
    learned = {lang: Substrings(" ".join(again.choice(words, 25))) for lang, words in LANGS.items()}  # one piece each: no joint
    texts = [" ".join(rng.choice(LANGS["aa"] + LANGS["bb"] + ["xyzzy", "éa"], 12)) for _ in range(40)]
    names, score, _ = language.parse(texts, model)
    for text, name, value in zip(texts, names, score, strict=True):
        cost = [brute_phrases(text, learned[lang]) * language.bits(m) for lang, m in zip(model.names, model.automata, strict=True)]
        assert name == model.names[int(np.argmin(cost))] and value == pytest.approx(1 - min(cost) / max(cost))


def test_languages_of_disjoint_letters_are_told_apart_and_need_little_memory():
    rng = np.random.default_rng(2)

    def text(k, n):
        return " ".join("".join(chr(0x3400 + 600 * k + x) for x in rng.integers(0, 600, 3)) for _ in range(n))

    model = language.learn({f"l{k}": [text(k, 400) for _ in range(12)] for k in range(2)})
    want = [f"l{k % 2}" for k in range(60)]
    assert language.parse([text(k % 2, 30) for k in range(60)], model)[0] == want
    assert all(m.nbytes < 100 * m.letters for m in model.automata)


def test_long_texts_are_parsed_in_groups(monkeypatch):
    monkeypatch.setattr(language, "BATCH_LETTERS", 10)
    texts = ["abc", None, "defgh", "ij", "x" * 30, "", "kl", "mnopqrstu"]
    groups = list(language.by_length(texts))
    assert [t for g in groups for t in g] == texts and [len(g) for g in groups] == [4, 1, 2, 1] and list(language.by_length([])) == []


def test_a_language_that_was_not_learned_is_not_recognised():
    rng = np.random.default_rng(4)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))

    model = language.learn({"x": [text("abcdefgh", 300) for _ in range(20)], "y": [text("hijklmnop", 300) for _ in range(20)]})
    known = language.parse([text("abcdefgh", 100), text("hijklmnop", 100), text("qrstuv", 100), "qrst", "", "12"], model)
    assert known[2].tolist() == [True, True, False, True, False, False]


def test_languages(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(LANGS[lang], 30)), lang) for k in range(200) for lang in ["aa", "bb"][k % 2 : k % 2 + 1]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !? 34", None), (903, "LOREM IPSUM", None), (904, "lorem " * 20_000, "aa"), (904, "lorem", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    model = language.train(docs.filter("doc_id < 150"), F.lit(True))
    assert model.names == ["aa", "bb"]
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "recognised"]
    by = {(r["doc_id"], len(r["text"] or "")): r for r in got.collect()}
    assert all(r["lang_pred"] == r["lang"] for (k, _), r in by.items() if k < 200)
    assert [by[k]["lang_pred"] for k in ((900, 0), (901, 0), (902, 8))] == ["und"] * 3 and by[900, 0]["score"] == 0
    assert by[903, 11]["lang_pred"] == "aa" and by[904, 5]["lang_pred"] == "aa" and by[904, 120_000]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in by.values())
    none = language.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_every_letter_of_the_sample_counts():
    """Languages that differ in letters far beyond the most frequent ones only."""
    rng = np.random.default_rng(5)
    words = {lang: ["".join(chr(at + x) for x in rng.integers(0, 200, 3)) for _ in range(200)] for lang, at in (("both", 0x4E00), ("ja", 0x5E00), ("zh", 0x6E00))}
    own = {lang: words[lang] for lang in ("ja", "zh")}

    def text(lang, n):
        return "".join(rng.choice(words["both" if rng.random() < 0.8 else lang]) for _ in range(n))

    model = language.learn({lang: [text(lang, 400) for _ in range(30)] for lang in own})
    want = [lang for lang in own for _ in range(40)]
    assert language.parse([text(lang, 60) for lang in want], model)[0] == want
