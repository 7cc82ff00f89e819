"""Broken prompt and response pairs: clauses of the response tagged by a conditional random field.

Nobody has labelled the pairs. The field is trained on sound pairs of the data, taken by strict rules, and on copies of
them that are broken on purpose in each of the ways to be found. Only the weights are fitted on a sample: how words
are used, and the language of most questions, is counted over all pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from framequilt.llm.batches import in_batches
from framequilt.llm.bytecnn import ByteCNN
from framequilt.llm.crf import CRF
from framequilt.llm.languages import LEAST_LETTERS, weight
from framequilt.session import cut, parallelism

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
DEFECT = {"refusal": "refusal", "echo": "copies_question", "foreign": "other_language", "unfinished": "truncated"}
#: Bounds of the training sample: pairs, and characters of a question or an answer (pairs with longer ones are not drawn).
SAMPLE_PAIRS = 3_000
SAMPLE_CHARS = 20_000
#: Characters of all counted words up to which their table is broadcast to the answers left open; a larger one is joined by shuffle, with the same result.
BROADCAST_CHARS = 4_000_000
#: Share of an answer's words that a tag must cover to name its defect.
COVERAGE = 0.5

_MEDIA = re.compile(r"<(?:video|image)>")
_CLAUSE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？，；])|(?<=[,;])\s+|\n+")
_WORD = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+")
_CHOICE = re.compile(r"^\s*[\"'“]?\(?[A-Ha-h]\)?[.):]?[\"'”]?\s*$")
_DONE = re.compile(r"[.!?。！？][\"'”»)\]]*$")

# General cues of inability, of what merely can't be seen, of a speaker who means itself, and of regret. What else refusals say is learned from the data.
_CUES = {
    "unable": r"\b(?:cannot|can't|can not|could not|unable|not able|won't|will not|must decline|declined?|refuse[ds]?|refrain|rather not|prefer not|no way (?:for me|to)|not (?:willing|going|prepared|comfortable|in a position)|(?:do|does|will|can)(?:n't| not) (?:comment|answer|provide|discuss|assess|respond|support|tell|help)|not possible for|not allowed|not permitted|can be given|do(?:n't| not) have (?:the )?(?:access|ability)|comply|no puedo|ne peux pas|ne suis pas en mesure|kann (?:ich )?(?:leider )?nicht|não posso|non posso|kan (?:ik )?(?:helaas )?niet|не могу)\b|无法|不能回答",
    "seen": r"\b(?:cannot|can't|can not|could not|not) (?:(?:quite|yet|fully|clearly) )*(?:be )?(?:seen|visuali[sz]ed|identified|recogni[sz]ed|distinguished|made out)\b",
    "self": r"\b(?:i|i'm|i'd|i am|we|me|my|this (?:system|model|request|assistant|tool|service))\b|\bas an? (?:ai|assistant|language model|model)\b|作为",
    "regret": r"\b(?:sorry|apologies|apologi[sz]e|unfortunately|regret|lo siento|désolée?|leider|desculpe|lamento|mi dispiace|helaas|извините|к сожалению)\b|抱歉|对不起",
}
# Articles, prepositions, conjunctions and auxiliaries, which a bare phrase of a few words seldom has.
_CLOSED = set(
    "the a an of to in on at by for from with and or but that which is are was were be been has have it this we you as if while when so near over into before after once only not"
    " der die das den dem ein eine und oder mit von zu im am ist sind wird man le la les un une des du et ou avec de est sont on el los las una y o con del es se lo il gli e di che si per os as um uma com do da em het een en met van te wordt и с в на по не что"
    .split()
)
_CUE = {k: re.compile(v) for k, v in _CUES.items()}
_LCS_STEPS = (0.5, 0.7, 0.8, 0.9, 0.999)
_COVER_STEPS = (0.2, 0.4, 0.6, 0.8)
_ODDS_STEPS = (1.0, 3.0, 5.0, 8.0)
_STRANGE_STEPS = (0.15, 0.35, 0.6)
#: Share of finished answers below which a word's count makes it strange to them.
STRANGE = 0.01
#: Share of strange words below which a text is in the language of most answers, whatever the network takes it for.
FAMILIAR = 0.35
_LENGTH_STEPS = (6, 9)
_REFUSED_STEPS = (-1.0, 0.0, 0.7, 1.5, 2.5)
#: Share of sure refusals in which a word must occur to have log odds of its own, and the bounds of these.
REFUSED = 0.01
_LEAST_REFUSED, _MOST_REFUSED = -2.0, 4.0
#: A word in as large a share of answers counts as usual in them.
_USUAL = 1e-3


def plain(text: str | None) -> str:
    return _MEDIA.sub(" ", text).strip() if isinstance(text, str) else ""


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("_", " "))


def clauses(text: str) -> list[str]:
    return [c for p in _CLAUSE.split(text) if p and (c := p.strip()) and _WORD.search(c)]


def _cues(low: str) -> dict[str, bool]:
    hit = {k: bool(r.search(low)) for k, r in _CUE.items()}
    hit["unable"] = hit["unable"] and not hit["seen"]
    return hit


def sure_refusal(answer: str) -> bool:
    """A short answer in which a speaker that means itself, or regrets, states an inability: where the words of refusals are learned from."""
    if len(answer) > 400:
        return False
    hit = _cues(answer.lower().replace("’", "'"))
    return hit["unable"] and (hit["self"] or hit["regret"])


class InOrder:
    """Longest common subsequences with one text, however long: a row of the usual table is one integer, a bit for each word. Places of words are kept as such integers within KEPT_BYTES."""

    KEPT_BYTES = 64_000_000

    def __init__(self, whole: list[str]) -> None:
        self.n = len(whole)
        self.kept: dict[str, int] = {}
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(whole):
            self.places.setdefault(w, []).append(i)

    def _mask(self, w: str) -> int:
        m = self.kept.get(w)
        if m is None:
            bits = bytearray(self.n // 8 + 1)
            for i in self.places[w]:
                bits[i >> 3] |= 1 << (i & 7)
            m = int.from_bytes(bits, "little")
            if len(self.kept) * len(bits) < self.KEPT_BYTES:
                self.kept[w] = m
        return m

    def length(self, part: list[str]) -> int:
        every = (1 << self.n) - 1
        row = every
        for w in part:
            if w in self.places:
                hit = row & self._mask(w)
                row = ((row + hit) | (row - hit)) & every
        return self.n - row.bit_count()


def in_order(part: list[str], whole: list[str]) -> int:
    """Length of the longest common subsequence."""
    return InOrder(whole).length(part)


class Counts(dict):
    """How words are used: word to (n, last), see ``ending_counts``; ``refused``: word to the number of sure refusals it stands in, '' to that of all; ``asked``: the usual words of questions."""

    def __init__(self, used: dict[str, tuple[int, int]], refused: dict[str, int] | None = None, asked: frozenset[str] = frozenset()) -> None:
        super().__init__(used)
        self.refused = refused or {}
        self.asked = asked

    def __reduce__(self):
        return Counts, (dict(self), self.refused, self.asked)


def refused_odds(word: str, counts: Counts | dict) -> float:
    """Log odds of a word in sure refusals against finished answers; 0 for a word that neither uses often, and where no refusals are counted."""
    refused = getattr(counts, "refused", {})
    n_finished, n_refused = counts.get("", (0, -1))[0], refused.get("", 0)
    n, r = counts.get(word, (0, 0))[0], refused.get(word, 0)
    if not n_finished or not n_refused or (n == 0 and r == 0):
        return 0.0
    odds = np.log((r + 0.5) / (n_refused + 1)) - np.log((max(0, n - r) + 0.5) / (n_finished + 1) + _USUAL)
    return float(min(_MOST_REFUSED, max(_LEAST_REFUSED, odds)))


def ending(word: str, counts: Counts) -> int:
    """How often a word ends a sentence: 0 unknown, 1 hardly ever, 2 sometimes, 3 often."""
    n, last = counts.get(word, (0, 0))
    if n == 0:
        return 0
    return 1 if last * 50 < n else 2 if last * 6 < n else 3


def open_word(answer: str) -> str | None:
    """The word an answer is left open at, where its ending is looked at: no choice letter, and more than five words. Else null."""
    if _DONE.search(answer) or _CHOICE.match(answer):
        return None
    wc = [words(c) for c in clauses(answer)]
    return (wc[-1] or [""])[-1] if sum(map(len, wc)) > 5 else None


_NAMES = (
    [f"cue_{k}" for k in _CUES]
    + ["cue_self_unable", "cue_any", "cue_earlier"]
    + [f"strange_{i}" for i in range(len(_STRANGE_STEPS) + 1)]
    + ["strange_self", "strange_unable"]
    + [f"refused_{i}" for i in range(len(_REFUSED_STEPS) + 1)]
    + ["refused_strange", "refused_self"]
    + [f"lcs_{i}" for i in range(len(_LCS_STEPS) + 1)]
    + [f"cover_{i}" for i in range(len(_COVER_STEPS) + 1)]
    + ["lcs_and_cover", "prefix"]
    + [f"odds_{i}" for i in range(len(_ODDS_STEPS) + 1)]
    + [f"all_odds_{i}" for i in range(len(_ODDS_STEPS) + 1)]
    + ["question_unsure", "short_letters"]
    + ["last", "first", "only", "last_done", "last_open", "last_mark", "last_paren", "last_choice"]
    + [f"open_ending_{i}" for i in range(4)]
    + [f"open_length_{i}" for i in range(len(_LENGTH_STEPS) + 1)]
    + ["open_closed", "open_short_bare", "bare_unlike"]
    + ["bias"]
)
_AT = {n: i for i, n in enumerate(_NAMES)}


def features(pairs: list[tuple[str, str]], net: ByteCNN, counts: Counts, ends: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all clauses of all answers, clauses per answer, words per clause. Pairs are (question, answer), plain.

    ``ends`` are the counts of each answer's ``open_word``; without it they are looked up in ``counts``.
    """
    split = [clauses(a) for _, a in pairs]
    spoken = net.score([c for cs in split for c in cs])
    asked = net.score([q for q, _ in pairs])
    lengths = np.array([len(c) for c in split], dtype=np.int64)
    x = np.zeros((int(lengths.sum()), len(_NAMES)))
    size = np.zeros(len(x), dtype=np.int64)
    n_finished, home = counts.get("", (0, -1))
    usual = getattr(counts, "asked", frozenset())

    def unheard(ws: list[str]) -> list[bool]:
        return [counts.get(w, (0, 0))[0] < STRANGE * n_finished and not w.isdigit() for w in ws]

    refused_of: dict[str, float] = {}
    at = 0
    for no, ((q, a), cs, s) in enumerate(zip(pairs, split, asked, strict=True)):
        wq = words(q)
        bag, ordered = Counter(wq), InOrder(wq)
        wc = [words(c) for c in cs]
        cover = sum((bag & Counter(w for ws in wc for w in ws)).values()) / max(1, len(wq))
        order = np.argsort(s)
        lang, sure = int(order[-1]), bool(s[order[-1]] - s[order[-2]] >= 3.0 and weight(q) >= 8)
        if home >= 0 and weight(q) >= 8 and (s[lang] - s[home] < 3.3 or sum(unheard([w for w in wq if w not in usual])) < FAMILIAR * len(wq)):
            lang, sure = home, True  # a short question that may well be in the language of most, or one made of usual words
        own = spoken[at : at + len(cs)]
        total = own.sum(axis=0)
        each_odds = (own.max(axis=1) - own[:, lang]).tolist() if sure and len(cs) else [0.0] * len(cs)
        all_odds = float(total.max() - total[lang]) if len(cs) and sure else 0.0
        enough = weight(a) >= LEAST_LETTERS
        # words can only be strange in the language of most answers
        odd = [unheard(ws) if lang == home else [] for ws in wc]
        if lang == home and sum(map(sum, odd)) < FAMILIAR * sum(map(len, wc)):
            all_odds = 0.0
        earlier = False
        done = bool(_DONE.search(a))
        n_words = sum(map(len, wc))
        for i, (c, ws) in enumerate(zip(cs, wc, strict=True)):
            f = x[at + i]
            size[at + i] = max(1, len(ws))
            low = c.lower().replace("’", "'")
            hit = _cues(low)
            for k, v in hit.items():
                f[_AT[f"cue_{k}"]] = v
            f[_AT["cue_self_unable"]] = hit["self"] and hit["unable"]
            strange = sum(odd[i]) / max(1, len(ws))
            f[_AT[f"strange_{bisect_right(_STRANGE_STEPS, strange)}"]] = 1
            f[_AT["strange_self"]] = strange >= 0.35 and hit["self"]
            f[_AT["strange_unable"]] = strange >= 0.35 and hit["unable"]
            for w in ws:
                if w not in refused_of:
                    refused_of[w] = refused_odds(w, counts)
            refused = sum(refused_of[w] for w in ws) / max(1, len(ws))
            f[_AT[f"refused_{bisect_right(_REFUSED_STEPS, refused)}"]] = 1
            f[_AT["refused_strange"]] = refused >= 0.7 and strange >= 0.35
            f[_AT["refused_self"]] = refused >= 0.7 and hit["self"]
            any_cue = hit["unable"] or hit["regret"]
            f[_AT["cue_any"]] = any_cue
            f[_AT["cue_earlier"]] = earlier
            earlier = earlier or any_cue
            bare = ws[1:] if len(ws) > 1 and ws[0] in ("question", "answer") else ws
            # a subsequence in common is no longer than the words in common, and below the first step its length doesn't matter
            common = sum(min(bag[w], k) for w, k in Counter(bare).items() if w in bag) / max(1, len(bare))
            ratio = ordered.length(bare) / len(bare) if common >= _LCS_STEPS[0] else 0.0
            lcs_step = bisect_right(_LCS_STEPS, ratio)
            cover_step = bisect_right(_COVER_STEPS, cover)
            f[_AT[f"lcs_{lcs_step}"]] = 1
            f[_AT[f"cover_{cover_step}"]] = 1
            f[_AT["lcs_and_cover"]] = ratio >= 0.75 and cover >= 0.6
            f[_AT["prefix"]] = len(bare) < len(ws)
            odds = each_odds[i] if lang != home or strange >= FAMILIAR else 0.0
            if not enough:
                odds = all_odds = 0.0
            f[_AT[f"odds_{bisect_right(_ODDS_STEPS, odds)}"]] = 1
            f[_AT[f"all_odds_{bisect_right(_ODDS_STEPS, all_odds)}"]] = 1
            f[_AT["question_unsure"]] = not sure
            f[_AT["short_letters"]] = not enough
            f[_AT["first"]] = i == 0
            f[_AT["only"]] = len(cs) == 1
            f[_AT["bias"]] = 1
            if i == len(cs) - 1:
                f[_AT["last"]] = 1
                choice = bool(_CHOICE.match(a))
                f[_AT["last_choice"]] = choice
                f[_AT["last_done"]] = done
                if not done and not choice:
                    f[_AT["last_open"]] = 1
                    f[_AT["last_mark"]] = bool(re.search(r"(?:[,;:\-–—…，、]|\.\.\.)\s*$", a))
                    f[_AT["last_paren"]] = a.count("(") > a.count(")")
                    last = ws[-1] if ws else ""
                    end = ending(last, counts if ends is None else Counts({last: ends[no]}))
                    if n_words > 5:
                        f[_AT[f"open_ending_{end}"]] = 1
                    f[_AT[f"open_length_{bisect_right(_LENGTH_STEPS, n_words)}"]] = 1
                    closed = any(w in _CLOSED for part in wc for w in part)
                    f[_AT["open_closed"]] = closed
                    bare_phrase = n_words <= 5 and not closed and not f[_AT["last_mark"]] and not f[_AT["last_paren"]]
                    f[_AT["open_short_bare"]] = bare_phrase
                    f[_AT["bare_unlike"]] = bare_phrase and cover < 0.5
        at += len(cs)
    return x, lengths, size


def ending_counts(answers: list[str]) -> Counts:
    """How often each word of finished answers occurs, how often it ends a sentence, and in how many sure refusals it stands; under '' the number of finished answers, -1, and the number of sure refusals."""
    n: Counter[str] = Counter()
    last: Counter[str] = Counter()
    refused: Counter[str] = Counter()
    for a in answers:
        if _DONE.search(a):
            n[""] += 1
            for s in re.split(r"(?<=[.!?。！？])\s*", a):
                if ws := words(s):
                    n.update(ws)
                    last[ws[-1]] += 1
        if sure_refusal(a):
            refused[""] += 1
            refused.update(set(words(a)))
    return Counts({w: (n[w], last[w]) for w in n.keys() | refused.keys()} | {"": (n[""], -1)}, refused)


def asked_counts(questions: list[str], often: list[int]) -> Counter[str]:
    """In how many questions each word stands; under '' the number of all with a letter. ``often`` is how often each question is asked."""
    n: Counter[str] = Counter()
    for q, k in zip(questions, often, strict=True):
        if weight(q) > 0:
            for w in {"", *words(q)}:
                n[w] += k
    return n


class Corpus(NamedTuple):
    """What is counted over all pairs: a table of word, n, last, refused (see ``ending_counts``), finished answers, sure refusals, the language of most questions (-1: none), characters of all words, and the words that stand in a share of STRANGE of the questions or more (at most 1 / STRANGE times the mean words of a question)."""

    table: DataFrame
    n_finished: int
    n_refused: int
    home: int
    chars: int
    asked: frozenset[str]

    def known(self, wanted: set[str]) -> Counts:
        """Counts of the ``wanted`` words, of those that aren't strange and of those that refusals use: at most 1 / STRANGE times the mean words of a finished answer, and 1 / REFUSED times those of a sure refusal."""
        asked = self.table.sparkSession.createDataFrame([(w,) for w in sorted(wanted)], "word string")
        often = (F.col("n") >= F.lit(STRANGE) * self.n_finished) | ((F.col("refused") > 1) & (F.col("refused") >= F.lit(REFUSED) * self.n_refused))
        rows = self.table.join(F.broadcast(asked), "word", "left_semi").unionByName(self.table.filter(often))
        found = rows.collect()
        return Counts({r["word"]: (r["n"], r["last"]) for r in found} | {"": (self.n_finished, self.home)}, {r["word"]: r["refused"] for r in found} | {"": self.n_refused}, self.asked)


def corpus_counts(pairs: DataFrame, question: str, answer: str, net: ByteCNN) -> Corpus:
    """Counts over every pair and whole texts, added up within each batch and each task before the shuffle. Each distinct question is scored once; those without a letter don't count."""
    held = pairs.sparkSession.sparkContext.broadcast(net)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = ending_counts([plain(a) for a in pdf["a"]])
            yield pd.DataFrame([(w, k, max(0, last), n.refused.get(w, 0)) for w, (k, last) in n.items()], columns=["word", "n", "last", "refused"])

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = [plain(t) for t in pdf["q"]]
            own = np.array([weight(t) > 0 for t in q], dtype=bool)
            n = np.bincount(held.value.score(q).argmax(axis=1), weights=pdf["n"].to_numpy() * own, minlength=len(held.value.classes))
            heard = asked_counts(q, pdf["n"].tolist())
            # a language's number stands behind '#', which is in no word
            yield pd.DataFrame({"word": [*(f"#{i}" for i in range(len(n))), *heard], "n": [*n.astype(np.int64), *heard.values()]})

    told = pairs.select(F.col(answer).alias("a")).filter("a IS NOT NULL").mapInPandas(count, "word string, n bigint, last bigint, refused bigint")
    table = cut(told.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "last", "refused")]))
    none = F.col("word") == ""
    whole = table.agg(F.sum(F.when(none, F.col("n"))).alias("n"), F.sum(F.when(none, F.col("refused"))).alias("r"), F.sum(F.length("word")).alias("chars")).first()
    asked = pairs.select(F.col(question).alias("q")).filter("q IS NOT NULL").groupBy("q").agg(F.count("*").alias("n"))
    heard = cut(asked.repartition(parallelism(pairs.sparkSession), "q").mapInPandas(spoken, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    langs = {int(r["word"][1:]): r["n"] for r in heard.filter("n > 0 AND word LIKE '#%'").collect()}
    home = min(langs, key=lambda k: (-langs[k], k)) if langs else -1
    usual = heard.filter((F.col("word") > "") & ~F.col("word").startswith("#") & (F.col("n") >= F.lit(STRANGE) * sum(langs.values()))).collect()
    return Corpus(table.filter("word <> ''"), whole["n"] or 0, whole["r"] or 0, home, whole["chars"] or 0, frozenset(r["word"] for r in usual))


# Parts of refusals that training pairs are given, beside the data's own sure refusals.
_OPENERS = ("", "I'm sorry, but ", "Unfortunately ", "Apologies, ", "As an AI model ", "As an assistant ", "Sorry, ")
_CORES = (
    "I cannot help with this", "I am unable to answer this question", "I can't help with that", "I am not able to say", "I won't discuss this",
    "I must decline to answer", "I do not have access to it", "this can't be answered", "it is not possible for me to say", "no answer can be given here", "unable to help", "declined",
    "I would rather not say", "this assistant does not discuss that", "there is no way to know from here", "I prefer not to say", "that is outside what I may discuss",
)
_TAILS = ("", "", ". Please describe it instead", ", please ask somebody else", " and would need to know more", ", as this is against the rules", " now")
_TAILS_CUT = ("", "", "", ",", " -", "…", " —", " (the", " (about", " and", " and then", " the", " with a", " in", " which", " near the", " so that the")


def _echo(q: str, rng: np.random.Generator) -> str:
    w = q.split()
    if len(w) > 5 and rng.random() < 0.5:
        del w[rng.integers(1, len(w) - 1)]
    if len(w) > 5 and rng.random() < 0.2:
        w.insert(int(rng.integers(1, len(w))), str(rng.choice(["indeed", "also", "then"])))
    t = " ".join(w)
    kind = rng.integers(0, 6)
    if kind == 0:
        t = t.lower().rstrip("?.! ")
    elif kind == 1:
        t = str(rng.choice(["Question: ", "Answer: "])) + t
    elif kind == 2:
        t = f"“{t}”"
    elif kind == 3:
        t = t.rstrip("?.! ") + str(rng.choice([".", "", " ?", "!"]))
    return t


#: A tag, or parts of an answer with a tag each.
Kind = str | list[tuple[str, str]]


def _refusal(rng: np.random.Generator) -> str:
    t = str(rng.choice(_OPENERS)) + str(rng.choice(_CORES)) + str(rng.choice(_TAILS)) + str(rng.choice([".", "", "!"]))
    return t[0].upper() + t[1:]


def _phrase(text: str, rng: np.random.Generator) -> str:
    """Up to four neighbouring words of a text, none of them a function word, as one names a thing in short; '' where there are none."""
    runs: list[list[str]] = [[]]
    for c in clauses(text):
        for w in [*words(c), ""]:
            if w and w not in _CLOSED and not "㐀" <= w[0] <= "鿿":
                runs[-1].append(w)
            elif runs[-1]:
                runs.append([])
    runs = [r for r in runs if len(r) > 1]
    if not runs:
        return ""
    r = runs[int(rng.integers(len(runs)))]
    start = int(rng.integers(len(r) - 1))
    return " ".join(r[start : start + int(rng.integers(2, 5))]).capitalize()


def training_pairs(pairs: list[tuple[str, str]], foreign: list[tuple[str, str]], net: ByteCNN, seed: int = 0) -> list[tuple[str, str, Kind]]:
    """(question, answer, kind) of sound pairs, of the data's own sure refusals, and of broken copies. The kind is the tag of the answer's clauses, or a list of (text, tag) of its parts in order. ``foreign`` are (sentence, language)."""
    rng = np.random.default_rng(seed)
    asked = net.score([q for q, _ in pairs]) if pairs else np.zeros((0, 1))
    told = net.score([a for _, a in pairs]) if pairs else np.zeros((0, 1))
    out: list[tuple[str, str, Kind]] = []
    by_lang: dict[str, list[str]] = {}
    for s, k in foreign:
        by_lang.setdefault(k, []).append(s)

    def add(q: str, *parts: tuple[str, str]) -> None:
        out.append((q, " ".join(t for t, _ in parts), list(parts) if len(parts) > 1 else parts[0][1]))

    for (q, a), sq, sa in zip(pairs, asked, told, strict=True):
        if not words(a) or not words(q):
            continue
        lang = net.classes[int(sq.argmax())]
        hit = _cues(a.lower().replace("’", "'"))
        wa, wq = words(a), words(q)
        # a subsequence in common is no longer than the words in common
        common = sum((Counter(wa) & Counter(wq)).values()) >= 0.8 * len(wa)
        alike = common and in_order(wa, wq) >= 0.8 * len(wa) and len(wa) >= 0.6 * len(wq)
        same = weight(a) < LEAST_LETTERS or sa.argmax() == sq.argmax()
        if sure_refusal(a) and not alike and same:
            add(q, (a, "refusal"))
            continue
        done = bool(_DONE.search(a))
        short = len(wa) <= 5 and (bool(_CHOICE.match(a)) or (not re.search(r"[,\-–—…(]\s*$", a) and not any(w in _CLOSED for w in wa)))
        if hit["regret"] or hit["unable"] or alike or not same or not (done or short):
            continue
        add(q, (a, "answer"))
        whole = done and len(wa) >= 6
        if whole and rng.random() < 0.5:
            body = a.rstrip(".!?。 ")
            sentence = max((m.end() for m in re.finditer(r"[.!?。]\s*", body)), default=0)
            room = len(body) - sentence
            cut = sentence + int(rng.integers(max(1, room // 5), max(2, room - 2))) if room > 6 else 0
            if cut:
                t = body[:cut]
                if rng.random() < 0.6 and " " in t[sentence:].strip():
                    t = t[: t.rindex(" ")] + str(rng.choice(_TAILS_CUT[3:]))
                if not _DONE.search(t) and (len(words(t)) > 5 or any(w in _CLOSED for w in words(t))):
                    add(q, (t, "unfinished"))
        # a short phrase of the answer or the question is in their language and complete, however it looks to the network and however much of it the question has
        if rng.random() < 0.3 and (t := _phrase(a if rng.random() < 0.5 else q, rng)) and len(words(t)) < 0.5 * len(wq):
            add(q, (t, "answer"))
        if rng.random() < 0.15:
            add(q, (_refusal(rng), "refusal"))
        if rng.random() < 0.2:
            add(q, (_echo(q, rng), "echo"))
        others = [k for k in by_lang if k != lang]
        if others and rng.random() < 0.25:
            pick = by_lang[str(rng.choice(others))]
            add(q, (" ".join(str(rng.choice(pick)) for _ in range(int(rng.integers(1, 3)))), "foreign"))
        if whole and rng.random() < 0.15:
            # a sound answer with something else before or after it
            kind = str(rng.choice(["refusal", "echo", "foreign"]))
            extra = _refusal(rng) if kind == "refusal" else q if kind == "echo" else str(rng.choice(by_lang[str(rng.choice(others))])) if others else ""
            extra = extra if _DONE.search(extra) else f"{extra}."
            if words(extra):
                add(q, *([(extra, kind), (a, "answer")] if rng.random() < 0.5 else [(a, "answer"), (extra, kind)]))
    return out


def _tags(answer: str, kind: Kind) -> list[str]:
    """Tags of the answer's clauses; of an unfinished part only the last one is unfinished."""
    out: list[str] = []
    for t, tag in [(answer, kind)] if isinstance(kind, str) else kind:
        n = len(clauses(t))
        out += ["answer"] * (n - 1) + ["unfinished"] if tag == "unfinished" and n else [tag] * n
    return out


def train_tagger(pairs: list[tuple[str, str]], foreign: list[tuple[str, str]], net: ByteCNN, seed: int = 0, corpus: Corpus | None = None) -> tuple[CRF, Counts]:
    """The field, fitted on the bounded sample, and the counts of words that it needs; their entry '' also names the language of most questions.

    The counts are those of ``corpus``; without it ``pairs`` are taken as all there is.
    """
    made = training_pairs(pairs, foreign, net, seed)
    if corpus:
        counts = corpus.known({w for _, a, _ in made if (w := open_word(a))})
    else:
        counts = ending_counts([a for _, a in pairs])
        if pairs:
            counts[""] = (counts[""][0], int(np.bincount(net.score([q for q, _ in pairs]).argmax(axis=1)).argmax()))
            heard = asked_counts([q for q, _ in pairs], [1] * len(pairs))
            counts.asked = frozenset(w for w, k in heard.items() if w and k >= STRANGE * heard[""])
    crf = CRF(TAGS, len(_NAMES))
    # where a part's end is no end of a clause, its tags say nothing
    made = [(q, a, t) for q, a, kind in made if len(t := _tags(a, kind)) == len(clauses(a)) > 0]
    if not made:
        return crf, counts
    x, lengths, _ = features([(q, a) for q, a, _ in made], net, counts)
    crf.fit(x, np.array([TAGS.index(t) for _, _, tags in made for t in tags]), lengths)
    return crf, counts


def defect_of(p: np.ndarray, size: np.ndarray) -> str | None:
    """Defect of one answer from the tag probabilities of its clauses, by the words that each tag covers."""
    tags = p.argmax(axis=1)
    cover = np.bincount(tags, weights=size, minlength=len(TAGS)) / size.sum()
    whole = [TAGS.index(t) for t in ("echo", "refusal", "foreign")]
    most = max(whole, key=lambda k: cover[k])
    if cover[most] >= COVERAGE:
        return DEFECT[TAGS[most]]
    return DEFECT["unfinished"] if TAGS[tags[-1]] == "unfinished" else None


@F.pandas_udf(StringType())
def _open_words(answers: pd.Series) -> pd.Series:
    return pd.Series([open_word(plain(a)) for a in answers], dtype=object)


def defective_pairs(pairs: DataFrame, keep: list[str], question: str, answer: str, net: ByteCNN, tagger: tuple[CRF, Counts], corpus: Corpus | None = None) -> DataFrame:
    """Defective pairs: the columns ``keep`` (names other than defect) and defect (empty, truncated, refusal, copies_question, other_language).

    A null answer, or one without letter or digit apart from media tags, is empty. A null or empty question makes no
    answer a copy or foreign. Whole answers are read, whatever their length. Repeated rows give repeated results.
    The word that an answer is left open at is looked up in ``corpus``, or in the tagger's counts where none is given.
    """
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema}
    held = pairs.sparkSession.sparkContext.broadcast((net, *tagger))  # some hundred kB: bounded by the training sample and Corpus.known
    told = pairs.select(*keep, F.col(question).alias("__q"), F.col(answer).alias("__a"))
    if corpus:
        # answers that aren't left open match no word: '#' is none, and the hash spreads them
        told = told.withColumn("__word", F.coalesce(_open_words("__a"), F.concat(F.lit("#"), F.xxhash64("__q", "__a"))))
        table = corpus.table.select(F.col("word").alias("__word"), F.col("n").alias("__n"), F.col("last").alias("__last"))
        table = F.broadcast(table) if corpus.chars <= BROADCAST_CHARS else table.hint("shuffle_merge")
        told = told.join(table, "__word", "left").drop("__word").fillna(0, ["__n", "__last"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, crf, counts = held.value
        for pdf in batches:
            for part in in_batches(pdf, "__q", "__a"):
                qa = [(plain(q), plain(a)) for q, a in zip(part["__q"], part["__a"], strict=True)]
                ends = list(zip(part["__n"].tolist(), part["__last"].tolist(), strict=True)) if "__n" in part else None
                x, lengths, size = features(qa, model, counts, ends)
                p = crf.marginals(x, lengths[lengths > 0])
                found: list[str | None] = []
                at = 0
                for n in lengths.tolist():
                    found.append(defect_of(p[at : at + n], size[at : at + n]) if n else "empty")
                    at += n
                out = part[keep].copy()
                out["defect"] = found
                yield out[out["defect"].notna()]

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "defect string"])
    return told.mapInPandas(run, schema)
