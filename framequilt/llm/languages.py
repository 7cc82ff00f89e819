"""Language of documents and of the passages in them, by a byte convolutional network trained on the labelled documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequilt.functions.text import clean_str
from framequilt.llm.batches import in_batches
from framequilt.llm.bytecnn import ByteCNN, spoil, to_windows

# Codes and names of languages, by two-letter code.
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "es": ("es", "spa", "spanish", "español", "castilian"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文"),
}
LANGUAGES = list(LANGUAGE_NAMES)
_CODE = {n: code for code, names in LANGUAGE_NAMES.items() for n in names}

#: Bounds of the training sample: documents per language, sentences of each, characters read of each.
SAMPLE_DOCS = 260
SAMPLE_SENTENCES = 6
SAMPLE_CHARS = 8_000
EPOCHS = 8
#: Letters (ideographs count three) that a passage needs to stand for a language of its own.
LEAST_LETTERS = 15
#: Distinct words that a sentence needs to stand for a language of its own; an ideograph counts one.
LEAST_WORDS = 3
#: Least log odds of a passage's language against the document's main language.
LEAST_ODDS = 4.0

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])|\n+")
_ASIDE = re.compile(r"[(（][^()（）]{1,40}[)）]")
_BRACKET = re.compile(r"[(（]")
_QUOTE = re.compile(r"[\"“”„«»]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_IDEOGRAPH = re.compile(r"[㐀-鿿]")


def label_code(label: str | None) -> str | None:
    """Two-letter code that a label names, whatever its notation; None where it names none of the languages."""
    s = (label or "").strip().lower()
    return _CODE.get(s) or _CODE.get(re.split(r"[-_. ]", s)[0])


def sentences(text: str) -> list[str]:
    """Sentences without asides in brackets (single foreign terms stand there) and quotation marks."""
    if _BRACKET.search(text):
        parts = (_QUOTE.sub("", _ASIDE.sub(" ", p)).strip() for p in _SENTENCE.split(text) if p)
    else:
        parts = (_QUOTE.sub("", p).strip() for p in _SENTENCE.split(text) if p)
    return [s for s in parts if s and _LETTER.search(s)]


def once(s: str) -> str:
    """A sentence that mostly repeats itself says nothing more about its language each time: its distinct words."""
    words = s.split()
    seen = dict.fromkeys(words)
    return " ".join(seen) if len(words) >= 10 and 2 * len(seen) < len(words) else s


def weight(s: str) -> int:
    """Letters of a sentence, ideographs three times."""
    letters = len(_NO_LETTERS.sub("", s))
    return letters if s.isascii() else letters + 2 * len(_IDEOGRAPH.findall(s))


def says_enough(s: str) -> bool:
    """Whether a sentence has LEAST_WORDS distinct words, or as many ideographs."""
    seen = set()
    for m in _WORD.finditer(s):
        seen.add(m.group().lower())
        if len(seen) >= LEAST_WORDS:
            return True
    return len(_IDEOGRAPH.findall(s)) >= LEAST_WORDS


def code_column(label: Column) -> Column:
    """``label_code`` as a Column."""
    known = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])
    low = F.lower(clean_str(label))
    return F.coalesce(known[low], known[F.get(F.split(low, "[-_. ]"), F.lit(0))])


def labelled_sample(docs: DataFrame, text: str, label: str, doc_id: str) -> pd.DataFrame:
    """A bounded sample of labelled documents (columns text, code), the same for the same rows: SAMPLE_DOCS per language on average, by the hash of the id."""
    rows = docs.select(code_column(F.col(label)).alias("code"), F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)).alias("h")).filter("code IS NOT NULL AND length(trim(text)) > 0")
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "code": []})
    limit = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, int((1 << 30) * min(1.0, SAMPLE_DOCS / n)))])
    picked = rows.filter(F.col("h") <= limit[F.col("code")]).select("code", "text", "h").orderBy("h").limit(2 * SAMPLE_DOCS * len(LANGUAGES))
    return picked.toPandas().sort_values(["h", "text"])[["text", "code"]]


_TRAINED: dict[tuple[bytes, int], ByteCNN] = {}


def trained(sample: pd.DataFrame, seed: int = 0) -> ByteCNN:
    """``train``, once per sample in a process: queries over the same documents share the network. The last few are kept."""
    digest = hashlib.sha256()
    for t, c in zip(sample["text"], sample["code"], strict=True):
        digest.update(f"{c}\0{len(t)}\0{t}".encode("utf-8", "ignore"))
    key = (digest.digest(), seed)
    if key not in _TRAINED:
        while len(_TRAINED) >= 4:
            _TRAINED.pop(next(iter(_TRAINED)))
        _TRAINED[key] = train(sample, seed)
    return _TRAINED[key]


def train(sample: pd.DataFrame, seed: int = 0) -> ByteCNN:
    """Trains on sentences of the sample. Labels may be wrong: after half of the epochs sentences that the network contradicts are dropped, and it goes on with the rest and with spoiled copies."""
    rng = np.random.default_rng(seed)
    texts: list[str] = []
    y: list[int] = []
    for t, c in zip(sample["text"], sample["code"], strict=True):
        found = [s for s in sentences(t) if weight(s) >= LEAST_LETTERS]
        for i in rng.permutation(len(found))[:SAMPLE_SENTENCES]:
            texts.append(found[i])
            y.append(LANGUAGES.index(c))
    net = ByteCNN(LANGUAGES, seed)
    if not texts:
        return net

    def windows(of: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        x, owner, used = to_windows(of)
        keep = used >= 12
        return x[keep], np.array(labels)[owner[keep]]

    net.fit(*windows(texts, y), epochs=EPOCHS // 2, seed=seed)
    guess = net.score(texts).argmax(axis=1)
    kept = [i for i in range(len(texts)) if guess[i] == y[i]]
    texts, y = [texts[i] for i in kept], [y[i] for i in kept]
    net.fit(*windows(texts + [spoil(t, rng) for t in texts], y + y), epochs=EPOCHS - EPOCHS // 2, rate=0.006, seed=seed + 1)
    return net


def passages(parts: list[str], scores: np.ndarray, label: int | None = None, kept: list[str] | None = None) -> list[tuple[int, float, list[int], int]]:
    """Runs of sentences in one language: (language, confidence, sentences, letters).

    The main language has the most letters. A sentence counts for another one where it is long enough and its log odds
    against the main language suffice; a foreign run that doesn't is taken as main. A label stands unless the distinct
    sentences together speak against it by those odds: a text that repeats one word says little. ``kept`` are the
    sentences after ``once``, where the caller has them.
    """
    kept = [once(p) for p in parts] if kept is None else kept
    w = np.array([weight(p) for p in kept])
    whole = np.array([says_enough(p) for p in kept])
    best = scores.argmax(axis=1)
    # sentences of a word or two decide only where there are no others
    main = int(np.bincount(best, weights=w * (whole if whole.any() else 1), minlength=scores.shape[1]).argmax())
    if label is not None and label != main:
        first = list({p: i for i, p in enumerate(kept)}.values())
        if (scores[first, main] - scores[first, label]).sum() < LEAST_ODDS:
            main = label
    odds = scores.max(axis=1) - scores[:, main]
    lang = np.where(whole & (w >= LEAST_LETTERS) & (odds >= LEAST_ODDS), best, main)
    out: list[tuple[int, float, list[int]]] = []
    for i, k in enumerate(lang.tolist()):
        if out and out[-1][0] == k:
            out[-1][2].append(i)
        else:
            out.append((k, 0.0, [i]))
    done = []
    for k, _, at in out:
        z = scores[at].sum(axis=0) / max(1, len(at))
        z = z - z.max()
        done.append((k, float(np.exp(z[k]) / np.exp(z).sum()), at, int(w[at].sum())))
    return done


def identify(docs: DataFrame, text: str, keep: list[str], net: ByteCNN, with_text: bool = True, label: str | None = None) -> DataFrame:
    """One row per passage: the columns ``keep`` (names other than those below), passage (number), lang, confidence, letters, main_lang, main_confidence, passage_text (null unless ``with_text``). ``label`` names the column of ``keep`` that holds the two-letter code of the label, if there is one.

    Texts without any letter give no row. Whole texts are read, in windows of fixed length and in batches of bounded size.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    held = docs.sparkSession.sparkContext.broadcast(net)  # about 120 kB
    number = {code: i for i, code in enumerate(LANGUAGES)}
    cols = ["passage", "lang", "confidence", "letters", "main_lang", "main_confidence", "passage_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for pdf in batches:
            for part in in_batches(pdf, "__text"):
                split = [sentences(t) if isinstance(t, str) else [] for t in part["__text"]]
                codes = [number.get(x) for x in part[label]] if label else [None] * len(part)
                kept = [[once(s) for s in p] for p in split]
                scores = model.score([s for p in kept for s in p])
                rows, index, at = [], [], 0
                for i, p in enumerate(split):
                    own = scores[at : at + len(p)]
                    at += len(p)
                    if not p:
                        continue
                    runs = passages(p, own, codes[i], kept[i])
                    share = np.zeros(len(LANGUAGES))
                    conf = np.zeros(len(LANGUAGES))
                    for k, c, _, n in runs:
                        share[k] += max(n, 1e-6)
                        conf[k] += c * max(n, 1e-6)
                    main = int(share.argmax())
                    for no, (k, c, js, n) in enumerate(runs):
                        rows.append((no, LANGUAGES[k], c, n, LANGUAGES[main], conf[main] / share[main], " ".join(p[j] for j in js) if with_text else None))
                        index.append(i)
                out = part[keep].iloc[index].reset_index(drop=True)
                yield pd.concat([out, pd.DataFrame(rows, columns=cols)], axis=1)

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "passage bigint, lang string, confidence double, letters bigint, main_lang string, main_confidence double, passage_text string"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)
