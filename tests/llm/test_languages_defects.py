import os

import numpy as np
import pandas as pd
import pytest

from framequilt.llm import defects as D
from framequilt.llm.batches import in_batches
from framequilt.llm.bytecnn import ByteCNN, to_windows
from framequilt.llm.crf import CRF
from framequilt.llm.languages import LANGUAGES, identify, label_code, labelled_sample, once, passages, sentences, train

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_windows_cover_whole_texts():
    x, owner, used = to_windows(["", "ab", "x" * 1000, "é" * 97])
    assert used.tolist()[:2] == [0, 2] and sum(u for u, o in zip(used, owner, strict=True) if o == 2) == 1000 and sum(u for u, o in zip(used, owner, strict=True) if o == 3) == 194


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    net = ByteCNN(["a", "b"], 1)
    x, y = rng.integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    g = net._gradient(x, y)

    def loss():
        return -float(np.mean(net.log_probs(x)[np.arange(5), y]))

    for name in ("out", "kernel", "bias", "embed"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        old = net.p[name][at].copy()
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.15, abs=2e-3)


def test_labels():
    known = {"EN": "en", "en-US": "en", "en_GB": "en", "ger": "de", "Dutch": "nl", " zh-Hans ": "zh", "Português": "pt", "xx": None, "und": None, "n/a": None, "": None, None: None, "unknown": None}
    assert {k: label_code(k) for k in known} == known


def test_sentences():
    assert sentences('Wir sehen “das”. Now (bipolar grasper) we go!\n\n这里。那里。 123 ...') == ["Wir sehen das.", "Now   we go!", "这里。", "那里。"]
    assert sentences("") == [] and once("a b " * 20) == "a b" and once("a b c") == "a b c"


def test_passages_need_margin_and_length():
    scores = np.full((3, len(LANGUAGES)), -20.0)
    scores[0, 0], scores[1, 1], scores[2, 0] = -0.1, -0.1, -0.1
    long = [f"{c} {c * 2} {c * 20} {c * 17}" for c in "xyz"]
    assert [p[0] for p in passages(long, scores)] == [0, 1, 0]
    assert [p[0] for p in passages([long[0], "y" * 5, long[2]], scores)] == [0]
    assert [p[0] for p in passages([long[0], "y" * 40, long[2]], scores)] == [0]
    assert [p[0] for p in passages(["y" * 40], scores[1:2])] == [1] and [p[0] for p in passages(long[1:2], scores[1:2], 0)] == [1]
    scores[1, 0] = -1.0
    assert [p[0] for p in passages(long[1:2], scores[1:2], 0)] == [0]
    assert [p[0] for p in passages(long, scores)] == [0]


def test_crf_learns_transitions():
    rng = np.random.default_rng(3)
    x, y, lengths = [], [], []
    for _ in range(300):
        kind = int(rng.integers(0, 2))
        n = int(rng.integers(1, 5))
        lengths.append(n)
        for i in range(n):
            x.append([1.0, float(kind == 1 and i == 0), float(kind == 0 and i == 0)])
            y.append(kind)
    crf = CRF(["a", "b"], 3)
    x, y, lengths = np.array(x), np.array(y), np.array(lengths)
    crf.fit(x, y, lengths)
    p = crf.marginals(x, lengths)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.99
    assert crf.marginals(x[:0], lengths[:0]).shape == (0, 2)


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return train(labelled_sample(docs, "text", "lang", "doc_id"))


@needs_data
def test_held_out_accuracy(spark, net):
    """Sentences in two scripts of their own, and documents whose label agrees with their neighbours, from a table that the network hasn't seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 20 = 3").toPandas()
    docs["code"] = docs["lang"].map(label_code)
    docs = docs[docs["code"].notna() & docs["text"].notna()]
    hit = []
    for t, c in zip(docs["text"], docs["code"], strict=True):
        if s := sentences(t):
            hit.append(LANGUAGES[int(net.score(s).sum(axis=0).argmax())] == c)
    # about 7 % of the labels are wrong on purpose
    assert np.mean(hit) > 0.88


@needs_data
def test_identify(spark, net):
    rows = [(1, "Die Leber wird vorsichtig angehoben, damit die Sicht frei bleibt. The surgeon clips the cystic duct and the left hand keeps the liver bed in view."), (2, None), (3, ""), (4, "123 ..."), (5, "Now we see the gallbladder and the team lifts the liver bed (in situ). " * 300)]
    got = [(r["id"], r["lang"], r["main_lang"]) for r in identify(spark.createDataFrame(rows, "id int, body string"), "body", ["id"], net).collect()]
    assert [g for g in got if g[0] == 1] == [(1, "de", "en"), (1, "en", "en")] and [g for g in got if g[0] == 5] == [(5, "en", "en")] and {g[0] for g in got} == {1, 5}


@needs_data
def test_defects(spark, net):
    v = spark.read.parquet(f"{DATA}/vqa_rows.parquet").select("conversations").toPandas()
    pairs = [(D.plain(c[0]["value"]), D.plain(c[1]["value"])) for c in v["conversations"] if c is not None and len(c) > 1]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang in ('de', 'fr', 'es')").toPandas()
    foreign = [(s, c) for t, c in zip(docs["text"], docs["lang"], strict=True) if t for s in sentences(t)[:2]]
    sure = net.score([s for s, _ in foreign]).argmax(axis=1)
    foreign = [f for f, k in zip(foreign, sure, strict=True) if LANGUAGES[k] == f[1]]
    tagger = D.train_tagger(pairs, foreign, net)
    q = "What is the robotic wrist doing near the appendix base in this clip?"
    cases = {
        None: "empty", " ": "empty", "<video> —": "empty", "Yes": None, "(B)": None, "18 millimetres": None, "Cautery spatula": None, "The smoke clears and the portal vein appears at the edge of the field.": None,
        "No, the portal vein cannot be seen yet, and the team is still lifting the liver bed.": None, "The robotic wrist is lifting the appendix base slowly, because the mesh edge is still covered.": None,
        "The smoke clears and the border of the": "truncated", "It is safer to grasp the portal vein gently than to lift the mesh ed": "truncated", "Next, we clip the cystic duct in small bites, to leave the (about": "truncated",
        "I'm sorry, but I cannot view video content.": "refusal", "As an assistant I must decline to answer questions on patient care. Please provide a description instead": "refusal", "Unable to comply.": "refusal",
        q: "copies_question", "Question: " + q: "copies_question", q.lower().rstrip("?"): "copies_question", q.replace("robotic ", ""): "copies_question",
        "Jetzt sehen wir die Arterie, und der Operateur hebt den Nerv vorsichtig an.": "other_language", "Maintenant nous voyons l'artère et le chirurgien saisit le nerf sans tension.": "other_language",
    }
    rows = [(i, q, a, "x") for i, a in enumerate(cases)] + [(100, None, "Yes, it is visible here.", "x"), (101, "<video>", None, "x")]
    df = spark.createDataFrame(rows, "id int, question string, answer string, defect string")
    got = {r["id"]: r["defect"] for r in D.defective_pairs(df, ["id"], "question", "answer", net, tagger).collect()}
    wrong = {a: (got.get(i), want) for i, (a, want) in enumerate(cases.items()) if got.get(i) != want}
    assert not wrong, wrong
    assert got.get(100) is None and got[101] == "empty"
    assert D.defective_pairs(df.limit(0), ["id"], "question", "answer", net, tagger).collect() == []


@pytest.mark.parametrize("broadcast", [True, False])
def test_corpus_counts_are_of_all_pairs(spark, monkeypatch, broadcast):
    """What only stands outside the training sample counts: words, sentence ends and the language of questions, wherever the words' table goes."""
    if not broadcast:
        monkeypatch.setattr(D, "BROADCAST_CHARS", 0)
    net = ByteCNN(["a", "b"])
    net.fit(to_windows(["aaa?", "bbb?"] * 32)[0], np.array([0, 1] * 32), epochs=30)
    rows = [(i, "aaa?", "We lift the liver. Then we lift the graft.") for i in range(40)] + [(40 + i, "bbb?", "Now the team may lift it and rest on the liver") for i in range(60)] + [(200, None, None), (201, "?", "<video>")]
    df = spark.createDataFrame(rows, "id int, q string, a string").repartition(5)
    corpus = D.corpus_counts(df, "q", "a", net)
    got = {r["word"]: (r["n"], r["last"]) for r in corpus.table.collect()}
    assert got == {"we": (80, 0), "lift": (80, 0), "the": (80, 0), "liver": (40, 40), "then": (40, 0), "graft": (40, 40)}
    assert (corpus.n_finished, corpus.home) == (40, 1)
    _, counts = D.train_tagger([("aaa?", "Yes.")], [], net, corpus=corpus)
    assert counts["graft"] == (40, 40) and counts[""] == (40, 1)
    crf = CRF(D.TAGS, len(D._NAMES))
    crf.w[D._AT["open_ending_3"], D.TAGS.index("unfinished")] = 5.0
    found = D.defective_pairs(df, ["id"], "q", "a", net, (crf, {"": counts[""]}), corpus).collect()
    assert sorted(r["id"] for r in found if r["defect"] == "truncated") == list(range(40, 100))
    assert sorted(r["id"] for r in found if r["defect"] == "empty") == [200, 201]


def test_long_answers_are_trained_on(monkeypatch):
    seen = []
    long = ("What now?", "We lift it. " * 20, "answer")
    monkeypatch.setattr(D, "training_pairs", lambda *_: [long])
    monkeypatch.setattr(CRF, "fit", lambda _, x, y, lengths: seen.extend(lengths.tolist()))
    D.train_tagger([long[:2]], [], ByteCNN(["a", "b"]))
    assert seen == [20]


# Parts of pairs that the figures below are measured on; none of them is a part of what training pairs are made of.
_THINGS = ("liver bed", "portal vein", "mesh edge", "thyroid lobe", "gastric fundus", "cystic artery", "nerve root", "bladder neck", "dural sac", "jejunal loop")
_TOOLS = ("clip applier", "needle driver", "suction tip", "bone curette", "vessel sealer", "stapler")
_DOES = ("lifting", "sealing", "grasping", "rotating", "trimming", "marking")
_REFUSALS = (
    "I cannot view video content.", "I'm sorry, but I am not able to analyse this footage.", "As an assistant I must decline to answer questions on patient care", "Unfortunately I do not have access to the frames!",
    "We won't describe graphic scenes, please ask a qualified clinician.", "I can't help with medical imagery and would need more information", "This request can't be fulfilled.", "Unable to comply.", "I'd rather not answer that question.",
)
_OTHERS = ("Der Operateur hebt die Arterie vorsichtig an und hält den Nerv im Blick.", "On voit maintenant le foie et le chirurgien saisit le nerf sans tension.", "El cirujano levanta la arteria con cuidado y mantiene el nervio a la vista.")


def _pair_with_defect(rng) -> tuple[str, str, str | None]:
    one, two, tool, does = (str(rng.choice(x)) for x in (_THINGS, _THINGS, _TOOLS, _DOES))
    q = str(rng.choice([f"<video>\nWhat is the {tool} doing to the {one} in this clip?", f"Why is the {one} being handled with the {tool}?", f"Where does the {tool} lie relative to the {one}?"]))
    a = str(rng.choice([f"The {tool} is {does} the {one} carefully, so that the {two} comes into view.", f"At the edge of the field, the {tool} is {does} the {one} gently, because the {two} is still covered.", f"Only a narrow strip of the {two} stays behind, which protects the {one}."]))
    kind = rng.choice(["sound", "short", "empty", "truncated", "refusal", "copies_question", "other_language"], p=[0.4, 0.2, 0.08, 0.08, 0.08, 0.08, 0.08])
    if kind == "sound":
        return q, a, None
    if kind == "short":
        return q, str(rng.choice([f"Narrow {one}", tool.capitalize(), "Yes", "(B)", f"Poorly seen {two}", "12 millimetres", f"Superficial {one}"])), None
    if kind == "empty":
        return q, str(rng.choice(["", "-", "<video>", "..."])), "empty"
    if kind == "truncated":
        body = a.rstrip(".")
        words = body.split()
        k = int(rng.integers(6, len(words)))
        return q, str(rng.choice([" ".join(words[:k]) + " and the", " ".join(words[:k]) + " (about", " ".join(words[:k])[:-3] if len(words[k - 1]) > 5 else " ".join(words[:k]) + ","])), "truncated"
    if kind == "refusal":
        return q, str(rng.choice(_REFUSALS)), "refusal"
    if kind == "copies_question":
        plain = q.replace("<video>\n", "")
        return q, str(rng.choice([plain, plain.lower().rstrip("?"), f"Answer: {plain}"])), "copies_question"
    return q, str(rng.choice(_OTHERS)), "other_language"


@needs_data
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_precision_and_recall_of_each_defect(spark, net, seed):
    """Differently seeded pairs, trained on a sample of these and of the table's own."""
    rng = np.random.default_rng(seed)
    v = spark.read.parquet(f"{DATA}/vqa_rows.parquet").select("conversations").toPandas()
    own = [(D.plain(c[0]["value"]), D.plain(c[1]["value"])) for c in v["conversations"] if c is not None and len(c) > 1]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang in ('de', 'fr', 'es')").toPandas()
    foreign = [(s, c) for t, c in zip(docs["text"], docs["lang"], strict=True) if t for s in sentences(t)[:2]]
    sure = net.score([s for s, _ in foreign]).argmax(axis=1)
    tagger = D.train_tagger(own, [f for f, k in zip(foreign, sure, strict=True) if LANGUAGES[k] == f[1]], net, seed)
    made = [_pair_with_defect(rng) for _ in range(1500)]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(made)], "id int, q string, a string")
    got = {r["id"]: r["defect"] for r in D.defective_pairs(df, ["id"], "q", "a", net, tagger).collect()}
    for defect in ("empty", "truncated", "refusal", "copies_question", "other_language"):
        want = {i for i, m in enumerate(made) if m[2] == defect}
        found = {i for i, d in got.items() if d == defect}
        right = len(want & found)
        assert right >= 0.95 * len(want) and right >= 0.95 * len(found), (defect, len(want), len(found), right, [made[i][1] for i in sorted(want ^ found)][:8])


class _Misled:
    """A network that takes short phrases, and one question that is often asked, for French."""

    classes = ["en", "fr"]

    def score(self, texts):
        french = lambda t: "le " in t.lower() or t == "What action is being performed?" or 1 < len(t.split()) <= 3
        return np.array([[-6.0, 0.0] if french(t) else [0.0, -6.0] for t in texts]).reshape(-1, 2)


def test_a_misled_network_makes_no_defects():
    """Words that most questions and answers use tell their language, whatever the network says; short phrases are complete."""
    rng = np.random.default_rng(3)
    pairs = []
    while len(pairs) < 600:
        q, a, kind = _pair_with_defect(rng)
        if kind is None:
            pairs.append(("What action is being performed?" if len(pairs) % 5 == 0 else q.replace("<video>\n", ""), a))
    net = _Misled()
    crf, counts = D.train_tagger(pairs, [("Nous tenons le nerf sous traction.", "fr"), ("On voit le foie et le rein.", "fr")] * 5, net)
    frequent, other = "What action is being performed?", "Why is the portal vein being handled with the stapler?"
    sound = [(frequent, "The stapler is sealing the portal vein carefully, so that the nerve root comes into view."), (other, "Superficial nerve root"), (frequent, "Narrow bladder neck"), (other, "Portal vein")]
    french = [(frequent, "Le chirurgien saisit le nerf sans tension."), (other, "Il faut garder le foie en vue.")]
    x, lengths, size = D.features([*sound, *french], net, counts)
    p, at = crf.marginals(x, lengths), np.concatenate([[0], np.cumsum(lengths)])
    assert [D.defect_of(p[i:j], size[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)] == [None] * len(sound) + ["other_language"] * len(french)


def test_usual_words_of_questions(spark):
    assert D.asked_counts(["What now?", "?", "now now"], [3, 9, 2]) == {"": 5, "what": 3, "now": 5}
    rows = [(i, "aaa now?", "x") for i in range(300)] + [(300, "rare bbb?", "x"), (301, "?", "x"), (302, None, "x")]
    corpus = D.corpus_counts(spark.createDataFrame(rows, "id int, q string, a string"), "q", "a", ByteCNN(["a", "b"]))
    assert corpus.asked == {"aaa", "now"}


def test_refusals_teach_words():
    answers = ["I cannot comment on such footage."] * 5 + ["The surgeon lifts the liver."] * 200
    counts = D.ending_counts(answers)
    assert counts.refused[""] == 5 and D.refused_odds("footage", counts) > 2 and D.refused_odds("liver", counts) < 0 and D.refused_odds("unheard", counts) == 0
    assert not D.sure_refusal("The liver cannot be seen yet.") and not D.sure_refusal("We cannot be seen " * 60)


def test_batches_keep_to_their_bounds():
    pdf = pd.DataFrame({"t": ["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 4]})
    parts = [p["t"].tolist() for p in in_batches(pdf, "t", chars=10, rows=3)]
    assert parts == [["a" * 5, None], ["b" * 30], ["", "c" * 4, "d" * 4]] and list(in_batches(pdf.iloc[:0], "t")) == []


def test_scores_don_t_depend_on_what_is_scored_together():
    net = ByteCNN(["a", "b", "c"], 5)
    texts = ["ab", "", "the liver " * 40, "ж" * 100, "x"] * 3
    together = net.score(texts)
    assert np.allclose(together, np.concatenate([net.score([t]) for t in texts]), atol=1e-4)
    conv, _ = net._convolved(to_windows(texts)[0])
    top = np.maximum(conv.max(axis=1) + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"]
    lp = top - np.log(np.exp(top - top.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - top.max(axis=1, keepdims=True)
    assert np.allclose(net.log_probs(to_windows(texts)[0]), lp, atol=1e-4)


def test_in_order_equals_the_table():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (list(rng.choice(list("abcdef"), rng.integers(0, 30))) for _ in range(2))
        assert D.in_order(a, b) == plain(a, b)


def test_very_long_texts(spark):
    """Hundreds of thousands of words in question and answer, and texts without any end of a sentence."""
    net = ByteCNN(LANGUAGES)
    q = " ".join(f"word{i % 9000} does {i % 70}, and then it goes on" for i in range(30_000)) + "?"
    rows = [(1, q, q), (2, q, "x" * 1_500_000), (3, "What?", "a " * 700_000), (4, None, "é" * 1_000_000 + ".")]
    df = spark.createDataFrame(rows, "id int, q string, a string").repartition(2)
    tagger = D.train_tagger([("What is it?", "It is the liver, and it bleeds.")] * 4, [], net)
    assert D.defective_pairs(df, ["id"], "q", "a", net, tagger).count() <= 4
    assert {r["id"] for r in identify(df, "a", ["id"], net, with_text=False).select("id").distinct().collect()} == {1, 2, 3, 4}
