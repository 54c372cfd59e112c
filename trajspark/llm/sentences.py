"""Sentence boundaries across languages and scripts.

What a period means is learned from the documents themselves, per language, without labels:

1. words of each Latin-script language (from the noisy language labels), to tell the language of a
   document or clause; other scripts tell it themselves;
2. sentence starters: words whose log-likelihood ratio says they stand first in a line more often
   than elsewhere;
3. collocations: a word with a period and a next word that meet far more often than each meets
   others, by the same ratio ("9. Mai", "Prof. Dr.");
4. for every word before a period (or dots), how often a starter follows that isn't its collocation.
   A word whose ratio says that starters follow it significantly less than they follow periods at
   large is an abbreviation; numbers and dots are types like others.

Each period is then classified by these statistics; other marks, quotations, brackets, line breaks
and Thai spaces follow rules. Two passes over the documents learn, one splits; the second tells the
language of each document once and keeps it beside the text. All words of all documents count. The
learned types are held as hashed keys, 12 bytes each.
"""

import gc
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.plans.shared import cut
from trajspark.plans.sizes import at_most, spread

# Three-letter language codes and their two-letter forms.
TWO_LETTERS = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "kor": "ko", "hin": "hi", "ara": "ar", "tha": "th", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "tur": "tr"}

# End marks, quotation marks and brackets.
END = ".!?。！？｡।॥؟…‼⁇⁈⁉．"
DOTS = ".…．"
PAIRS = {"“": "”“", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
OPENERS = "“„«»「『(（[【《\"'‘¿¡‹"
CLOSERS = "”“»」』)）]】》\"'’›"
BRACKETS = "(（[【"

LINES = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
MARK = re.compile(r"\s*(?:(?:\d{1,4}|[A-Za-z])[.)](?=\s)|[-*•–—·▪◦‣]+(?=\s))\s*")
NUMBERED = re.compile(r"\s*\d{1,4}[.](?=\s)")
# a single period right before a digit or small letter (13.7, file.txt) never ends a sentence
EVENTS = re.compile(r"(?:\.(?![0-9a-z])|[" + re.escape(END.replace(".", "")) + "])[" + re.escape(END) + "]*|[\"" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")
THAI = re.compile("[฀-๿]")
THAI_EVENTS = re.compile(EVENTS.pattern + "|(?<=[฀-๿])\\s+(?=[฀-๿])")
WORDS = re.compile(r"\S+")
MARKS = re.compile("[\"" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-z]+)?")
QUOTED = re.compile('"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|»[^«\n]*«|「[^」\n]*」|『[^』\n]*』|\\([^()\n]*\\)|（[^（）\n]*）|\\[[^\\[\\]\n]*\\]|【[^】\n]*】|《[^》\n]*》')
LIST_MARK = re.compile(r"(?:\d{1,4}|[A-Za-z])[.)]|[-*•–—·▪◦‣]+")
STOPS = frozenset(".…!?।؟")

#: Significance of starters, collocations and abbreviations; fewest uses of a learned type; how many
#: times likelier a collocation's second word must be after its first.
STARTER_LLR = 12.0
COLLOCATION_LLR = 12.0
ABBREVIATION_LLR = 12.0
LEAST_COUNT = 5
COLLOCATED = 10.0
#: Words with at least this share of a label's words tell its language: at most 5,000 a label. A label
#: needs so many words; labels are codes of two or three letters, of which there are 18,252.
WORD_SHARE = 2e-4
LABEL_WORDS = 500
#: Most learned types (12 bytes each) that are shipped to the tasks; more are an error, not left out.
MOST_TYPES = 20_000_000


@lru_cache(maxsize=1 << 16)
def script_of(c: str) -> str:
    """The script of one character, as far as boundaries depend on it: l(atin), c(yrillic), other letters by language."""
    o = ord(c)
    if o < 0x250:
        return "l" if c.isalpha() else ""
    if 0x370 <= o < 0x530:
        return "c"
    if 0x600 <= o < 0x780:
        return "ar"
    if 0x900 <= o < 0x980:
        return "hi"
    if 0xE00 <= o < 0xE80:
        return "th"
    if 0xAC00 <= o < 0xD7B0 or 0x1100 <= o < 0x1200:
        return "ko"
    if 0x3040 <= o < 0x3100:
        return "ja"
    if 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x32000:
        return "zh"
    return "l" if c.isalpha() and o < 0x2000 else ""


SCRIPTS = ("", "l", "c", "ar", "hi", "th", "ko", "ja", "zh")


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """The number of each code point's script among SCRIPTS; the last entry stands for all beyond."""
    return np.array([SCRIPTS.index(script_of.__wrapped__(chr(o))) for o in range(0x32000)] + [0], np.uint8)


def scripts(text: str) -> Counter:
    """How many characters of each script a text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _script_table()
    return Counter({k: int(n) for k, n in zip(SCRIPTS, np.bincount(table[np.minimum(codes, len(table) - 1)], minlength=len(SCRIPTS))) if k and n})


def cased(c: str) -> bool:
    return c.lower() != c.upper()


def label_of(lang: str | None) -> str:
    """A language label in one spelling; '' if there is none."""
    s = re.split(r"[-_]", (lang or "").strip().lower())[0]
    return TWO_LETTERS.get(s, s) if re.fullmatch("[a-z]{2,3}", s) else ""


@lru_cache(maxsize=1 << 17)
def core(token: str) -> str:
    """The key of a token: without outer punctuation, case and digits' values."""
    w = token.strip(OPENERS + CLOSERS + ",;:!?…،؛，。、")
    if w.endswith("."):
        w = w.rstrip(".")
    if not w:
        return token[:1] if token else ""
    if w[0].isupper() and (w.endswith("'s") or w.endswith("’s")) and w[1:2].islower():
        return "##'s"
    if any(c.isdigit() for c in w):
        return "##" if all(c.isdigit() or c in ".,-−+%" for c in w) else "##mixed"
    return w.lower()


@lru_cache(maxsize=1 << 17)
def head(token: str) -> str:
    """The key of a token that may begin a sentence: abbreviations keep their period."""
    c = core(token)
    return c + "." if c[:1].isalpha() and token.rstrip(CLOSERS).endswith(".") else c


def type_key(kind: str, lang: str, word: str) -> int:
    """Hash of a learned type, equal to the engine's xxhash64 of the three strings."""
    h = 42
    for x in (kind, lang, word):
        h = xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


class Types:
    """Learned numbers by (kind, language, word), as sorted hashes; remembers what it was asked."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None):
        keys = np.zeros(0, np.int64) if keys is None else keys
        order = np.argsort(keys)
        self.keys, self.values = keys[order], (np.zeros(0, np.float32) if values is None else values)[order]
        self.known: dict[tuple[str, str, str], float | None] = {}

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.keys, self.values = state
        self.known = {}

    def get(self, kind: str, lang: str, word: str) -> float | None:
        k = (kind, lang, word)
        try:
            return self.known[k]
        except KeyError:
            if len(self.known) > 1_000_000:
                self.known.clear()
        h = type_key(kind, lang, word)
        i = int(np.searchsorted(self.keys, h))
        self.known[k] = found = float(self.values[i]) if i < len(self.keys) and self.keys[i] == h else None
        return found


#: What a period type means: its number among the types.
KINDS = {0.0: "ends", 1.0: "mixed", 2.0: "never"}


@dataclass
class Model:
    """What was learned: word weights per Latin-script language, starters, common words and period types."""

    words: list[str] = field(default_factory=list)  # the languages
    weights: dict[str, tuple[float, ...]] = field(default_factory=dict)  # word: weight for each of them
    types: Types = field(default_factory=Types)

    def starter(self, lang: str, word: str) -> float | None:
        """The share of a starter's uses that begin a line or sentence; None for other words."""
        return self.types.get("starter", lang, word)

    def common(self, lang: str, word: str) -> bool:
        """Whether the word is written in lower case within sentences."""
        return self.types.get("common", lang, word) is not None

    def period(self, lang: str, word: str) -> str | None:
        """never, mixed or ends for a word with its mark; None if nothing was learned."""
        return KINDS.get(self.types.get("period", lang, word))

    def latin(self, words: list[str], among: list[str] | None = None, default: str = "en") -> str:
        """The likeliest of the Latin-script languages."""
        hits = [x for x in map(self.weights.get, words) if x]
        if not hits:
            return default
        best, name = 0.0, default
        for lang, score in zip(self.words, map(sum, zip(*hits))):
            if score > best and (among is None or lang in among):
                best, name = score, lang
        return name

    def language(self, text: str) -> str:
        """A document's language: its main script, or for Latin script its words."""
        if not text.isascii():
            n = scripts(text)
            if not n:
                return "en"
            if n["ja"] and n["ja"] * 8 > n["zh"] and n["ja"] + n["zh"] > n["l"] / 2:
                return "ja"
            top = n.most_common(1)[0][0]
            if top != "l" and n["l"] <= 3 * n[top]:
                return "ru" if top == "c" else top
            rest = [k for k in n if k != "l" and n[k] * 4 > n["l"]]
            if rest:
                return "ru" if rest[0] == "c" else rest[0]
        return self.latin(text.lower().split())


CASELESS = {"ar", "hi", "th", "ko", "ja", "zh"}


_AFTER_END = re.compile(r"[.!?](?<=[^\W\d_]{4}.)\s+[" + re.escape(OPENERS) + r"]*([^\W\d_])")
_LINE_START = re.compile(r"[\n\r](?:\s*(?:\d{1,4}[.)]|[-*•–—·▪◦‣]+)(?=\s))?\s*[" + re.escape(OPENERS) + r"]*([^\W\d_])")


def lowered(text: str) -> bool:
    """Whether the document starts its sentences in lower case: words of four letters end them, to pass over abbreviations."""
    firsts = "".join(_AFTER_END.findall(text)) + "".join(_LINE_START.findall("\n" + text))
    return sum(map(str.islower, firsts)) > sum(map(str.isupper, firsts))


# ---------------------------------------------------------------- learning


def _uncollected(run):
    """A function on batches without the garbage collector, whose scans of the many small tuples cost a tenth of the time; there are no cycles to find."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return wrapped


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by label: (lang, w, n). Words are told from their marks once per distinct token."""
    by: dict[str, Counter] = {}

    def flush():
        rows: Counter = Counter()
        for label, tokens in by.items():
            for t, n in tokens.items():
                for w in LATIN.findall(t):
                    rows[label, w] += n
        by.clear()
        cols = list(zip(*[(*k, n) for k, n in rows.items()])) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "w", "n"])

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text and (label := label_of(lang)):
                if label not in by:
                    by[label] = Counter()
                by[label].update(text.lower().split())
        if sum(map(len, by.values())) > 300_000:
            yield flush()
    if by:
        yield flush()


#: Rows of the second pass: documents with their language, and counts of words and of words that meet.
_ROWS = pa.schema([("what", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("low", pa.bool_()), ("a", pa.string()), ("b", pa.string()), ("kind", pa.string()), ("n", pa.int64())])
_ROWS_DDL = "what string, doc_id long, text string, lang string, low boolean, a string, b string, kind string, n long"


class _Counts:
    """Tokens of sentences and lines, counted as they are written; their keys are found when they are handed on."""

    def __init__(self):
        self.all: dict[str, Counter] = {}
        self.first: dict[str, Counter] = {}
        self.after: dict[str, Counter] = {}

    def add(self, text: str, lang: str, low: bool) -> None:
        words, first, after = (d.setdefault(lang, Counter()) for d in (self.all, self.first, self.after))
        if MARKS.search(text):
            text = QUOTED.sub(" ¤ ", text)  # no sentence ends inside, whatever the word
        every, firsts, pairs = [], [], []
        for line in LINES.findall(text):
            tokens = line.split()
            if tokens and len(tokens[0]) < 6 and LIST_MARK.fullmatch(tokens[0]):
                del tokens[0]
            if not tokens:
                continue
            every += tokens
            firsts.append(tokens[0])
            pairs += [(a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] in STOPS]
        words.update(every)
        firsts += [b for a, b in pairs if a[-1] not in ".…"]
        first.update(firsts)
        if not low:
            after.update([p for p in pairs if p[0][-1] in ".…"])

    def __len__(self) -> int:
        return sum(len(c) for d in (self.all, self.first, self.after) for c in d.values())

    def rows(self) -> pa.RecordBatch:
        out: Counter = Counter()
        for what, counts in (("all", self.all), ("first", self.first)):
            for lang, tokens in counts.items():
                for t, n in tokens.items():
                    w = head(t)
                    if w and (w[0] == "#" or w[0].isalnum()):
                        out[what, lang, w, "", "lower" if t[0].islower() else ""] += n
        for lang, pairs in self.after.items():
            for (a, b), n in pairs.items():
                one = a[-1] == "." and a[-2:] != ".."
                nxt = b.lstrip(OPENERS)
                if not nxt or not nxt[0].isalpha():
                    kind = "other"
                else:
                    kind = "lower" if lang not in CASELESS and nxt[0].islower() else "upper"
                out["after", lang, core(a.rstrip(".…")) + ("." if one else "..."), head(nxt), kind] += n
        self.__init__()
        what, lang, a, b, kind = list(zip(*out)) or [()] * 5
        none = lambda t: pa.nulls(len(what), t)
        return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), none(pa.int64()), none(pa.string()), pa.array(lang, pa.string()), none(pa.bool_()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(kind, pa.string()), pa.array(out.values(), pa.int64())], schema=_ROWS)


def _prepare(model: Model, count: bool):
    """Documents with language and case, then the counts of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for b in batches:
            langs, lows = [], []
            for text in b.column(1).to_pylist():
                lang = model.language(text) if text else ""
                low = bool(text) and lang not in CASELESS and lowered(text)
                langs.append(lang), lows.append(low)
                if count and text:
                    counts.add(text, lang, low)
            none = lambda t, n=b.num_rows: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(["doc"] * b.num_rows, pa.string()), b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(langs, pa.string()), pa.array(lows, pa.bool_()), none(pa.string()), none(pa.string()), none(pa.string()), none(pa.int64())], schema=_ROWS)
            if len(counts) > 300_000:
                yield counts.rows()
        if len(counts):
            yield counts.rows()

    return run


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio of two binomials."""
    part = lambda k, n, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    return 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))


def languages(documents: DataFrame) -> Model:
    """A model that only tells languages, from all documents (text, lang)."""
    model = Model()
    docs = spread(documents.select("text", F.col("lang").cast("string").alias("lang")))
    words = docs.mapInArrow(_uncollected(_words), "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    words = words.withColumn("total", total).where(f"total >= {LABEL_WORDS} and n >= {LEAST_COUNT} and n >= {WORD_SHARE} * total")
    by: dict[str, dict[str, float]] = {}
    for r in words.collect():  # at most 5,000 words of each label
        by.setdefault(r["lang"], {})[r["w"]] = r["n"] / r["total"]
    # a language of another script has Latin words only from insertions
    names = sorted(k for k in by if k not in CASELESS and k not in ("ru", "uk", "bg", "el"))
    vocabulary = {w for k in names for w in by[k]}
    mean = {w: sum(by[k].get(w, 0) for k in names) / len(names) for w in vocabulary}
    model.words = names
    model.weights = {w: tuple(log((by[k].get(w, 0) + 1e-5) / (mean[w] + 1e-5)) for k in names) for w in vocabulary}
    return model


def _learned(rows: DataFrame) -> DataFrame:
    """(kind, lang, w, value) of all starters, common words, collocated numbers and period types.

    The sides broadcast have one row a language: at most the labels there can be, and the scripts.
    """
    n, some = F.sum("n"), lambda c: F.sum(F.when(F.expr(c), F.col("n")).otherwise(0))
    words = rows.where("what in ('all', 'first')").groupBy("lang", F.col("a").alias("w")).agg(some("what = 'first'").alias("k1"), some("what = 'all'").alias("k2"), (some("what = 'all' and kind = 'lower'") - some("what = 'first' and kind = 'lower'")).alias("lc"))
    words = cut(words.withColumn("k2", F.col("k2") - F.col("k1")))
    sums = words.groupBy("lang").agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2")).where("n1 > 0 and n2 > 0")
    scored = words.join(F.broadcast(sums), "lang")
    more = (F.col("k1") / F.col("n1") > F.col("k2") / F.col("n2")) & (_llr(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2")) >= STARTER_LLR)
    starters = scored.where(F.col("k1") >= LEAST_COUNT - 2).where(more).select(F.lit("starter").alias("kind"), "lang", "w", (F.col("k1") / (F.col("k1") + F.col("k2"))).alias("value"))
    common = scored.where(f"lc >= {LEAST_COUNT} and lc >= 0.5 * k2").select(F.lit("common").alias("kind"), "lang", "w", F.lit(1.0).alias("value"))

    pairs = cut(rows.where("what = 'after'").groupBy("lang", "a", "b", "kind").agg(n.alias("n")))
    ups = pairs.where("kind = 'upper'")
    firsts = pairs.groupBy("lang", "a").agg(n.alias("n1"))
    seconds = ups.groupBy("lang", "b").agg(n.alias("nb"))
    every = pairs.groupBy("lang").agg(n.alias("sn"))
    met = ups.where(F.col("n") >= LEAST_COUNT).join(firsts, ["lang", "a"]).join(seconds, ["lang", "b"]).join(F.broadcast(every), "lang").where("sn > n1")
    k1, n1, k2, n2 = F.col("n"), F.col("n1"), F.col("nb") - F.col("n"), F.col("sn") - F.col("n1")
    close = (k1 / n1 > COLLOCATED * k2 / n2) & (_llr(k1, n1, k2, n2) >= COLLOCATION_LLR)
    met = met.where(close).select("lang", "a", "b", F.lit(True).alias("met"))
    known = starters.select("lang", F.col("w").alias("b")).unionByName(common.select("lang", F.col("w").alias("b"))).distinct().withColumn("known", F.lit(True))
    told = cut(pairs.join(known, ["lang", "b"], "left").join(met, ["lang", "a", "b"], "left").withColumn("u", F.when((F.col("kind") == "upper") & F.col("known") & F.col("met").isNull(), F.col("n")).otherwise(0)))
    numbers = told.where("a = '##.' and kind = 'upper' and known is null and met").select(F.lit("period").alias("kind"), "lang", F.concat(F.lit("##.|"), "b").alias("w"), F.lit(2.0).alias("value"))

    follow = told.groupBy("lang", F.col("a").alias("w")).agg(F.sum("u").alias("u"), n.alias("n"))
    sums = told.groupBy("lang").agg(F.sum("u").alias("su"), n.alias("sn"))
    rated = follow.where(F.col("n") >= LEAST_COUNT).join(F.broadcast(sums), "lang")
    rest_u, rest_n = F.col("su") - F.col("u"), F.col("sn") - F.col("n")
    ratio = F.when(rest_n > 0, _llr(F.col("u"), F.col("n"), rest_u, F.greatest(rest_n, F.lit(1)))).otherwise(0.0)
    share = F.col("u") / F.col("n")
    rare = (share < F.col("su") / F.col("sn")) & (ratio >= ABBREVIATION_LLR)
    value = F.when((share >= 0.6) | ~(rare | (share < 0.1)), 0.0).when(share < 0.02, 2.0).otherwise(1.0)
    # a word that ends sentences is what an unknown word is taken for, unless it is short or before dots
    odd = F.col("w").rlike(r"^.\.$|\..*\.$")
    types = rated.select(F.lit("period").alias("kind"), "lang", "w", value.alias("value")).where(odd | (F.col("value") > 0))
    return starters.unionByName(common).unionByName(types).unionByName(numbers)


def learn(rows: DataFrame, model: Model) -> Model:
    """Adds to a model of languages what the counts of the second pass say."""
    found = cut(_learned(rows).select(F.xxhash64("kind", "lang", "w").alias("key"), F.col("value").cast("float").alias("value")))
    if not at_most(found, MOST_TYPES):
        raise ValueError(f"more than {MOST_TYPES} types were learned")
    t = found.toArrow()
    return Model(model.words, model.weights, Types(t.column("key").to_numpy(), t.column("value").to_numpy()))


def _prepared(documents: DataFrame, model: Model, count: bool) -> DataFrame:
    """Documents with their language and case and, with `count`, the counts to learn from; stored, so that each is told once."""
    ids = F.col("doc_id") if "doc_id" in documents.columns else F.lit(None).cast("bigint").alias("doc_id")
    return cut(spread(documents.select(ids, "text")).mapInArrow(_uncollected(_prepare(model, count)), _ROWS_DDL))


def train(documents: DataFrame) -> Model:
    """Learns a model from all documents (text, lang); two passes, partial counts summed by shuffle.

    Null and empty texts count for nothing; without any text the model is empty and every period
    before white space ends a sentence.
    """
    model = languages(documents)
    return learn(_prepared(documents, model, True), model)


# ---------------------------------------------------------------- splitting


def _spans(line: str) -> list[tuple[int, int]]:
    """Outermost pairs of quotation marks or brackets within a line, as (open, close)."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in MARKS.finditer(line):
        i, c = m.start(), m.group()
        if c == '"':
            k = next((x for x in range(len(stack) - 1, -1, -1) if stack[x][0] == '"'), None)
            if k is not None:
                found.append((stack[k][1], i))
                del stack[k:]
            else:
                stack.append((c, i))
            continue
        k = next((x for x in range(len(stack) - 1, -1, -1) if c in PAIRS.get(stack[x][0], "")), None) if c in CLOSERS else None
        if k is not None:
            found.append((stack[k][1], i))
            del stack[k:]
        elif c in PAIRS and c != "»":
            stack.append((c, i))
    found.sort()
    out: list[tuple[int, int]] = []
    for o, c in found:
        if not out or o > out[-1][1]:
            out.append((o, c))
    return out


class Splitter:
    """Splits one document; holds its language and whether it is in lower case."""

    def __init__(self, model: Model, text: str, lang: str | None = None, low: bool | None = None):
        self.m, self.text = model, text
        self.lang = model.language(text) if lang is None else lang
        self.low = (self.lang not in CASELESS and lowered(text)) if low is None else low
        self.marked = MARKS.search(text) is not None
        self.events = THAI_EVENTS if not text.isascii() and THAI.search(text) else EVENTS

    def _clause(self, text: str) -> str:
        """Language of a few words: the document's, or English inserted into it."""
        if self.lang == "en":
            return "en"
        words = LATIN.findall(text.lower())
        if not words:
            return self.lang
        if self.lang in CASELESS or self.lang == "ru":
            return "en"
        return self.m.latin(words, [self.lang, "en"], self.lang)

    def _starts(self, nxt: str, rest: str, strict: bool) -> bool:
        """Whether the token `nxt` begins a sentence; with `strict` only if it is a learned starter."""
        w = nxt.lstrip(OPENERS)
        if not w:
            return True  # an opening mark by itself
        c, key = w[0], head(w)
        lang = self._clause(rest)
        share = self.m.starter(lang, key)
        if not c.isalpha():
            return not strict
        if not cased(c):
            return share is not None or not strict or script_of(c) in ("zh", "ja", "th")
        if share is not None and share >= 0.9 and (any(x.isupper() for x in w) or self.low):
            return True
        if self.low and self.lang == lang or (self.low and lang == "en"):
            if c.isupper():
                return False
            return share is not None if strict else True
        if not c.isupper():
            return False
        return share is not None or not strict or self.m.common(lang, key)

    def _period(self, line: str, begin: int, i: int, j: int) -> bool:
        """Whether the period or dots line[i:j] end a sentence that began at `begin`."""
        rest = line[j : j + 60]  # what follows, as far as it matters
        dots = line[i:j] != "."
        spaced = rest[:1].isspace()
        nxt = WORDS.search(line, j)
        if nxt is None:
            return True
        token = nxt.group()
        if token[0] in ",;:،؛，、" or (token[0] in "—–-" and not dots):
            return False
        before = line[begin:i]
        tok = before[before.rfind(" ") + 1 :]
        if "\t" in tok or "\u00a0" in tok:
            tok = re.split("[\t\u00a0]", tok)[-1]
        if not spaced:
            c = rest[0]
            if script_of(c) in ("zh", "ja", "ko", "ar", "hi", "th"):
                if dots or not tok:
                    return False
            elif not (c.isupper() and (rest[1:2].islower() or rest[1:2].isspace() or rest[1:2] == ".") and len(tok) > 0 and tok[-1:] not in "_/\\-"):
                if not (c in "“„«\"(「『（" and tok):
                    return False
        if dots and line[i] == "…" and script_of(tok[-1:] or " ") in ("zh", "ja"):
            return False
        if not tok:
            return spaced or dots
        key = core(tok)
        closed = tok[-1] in CLOSERS and tok[-1] != "'"
        lang = self._clause(before[-60:]) if not closed else self.lang
        kind = "ends" if closed else self.m.period(lang, key + ("..." if dots else "."))
        w = tok.lstrip(OPENERS)
        if kind is None:
            short = len(w) == 1 and w.isalpha() or ("." in w and not any(c.isdigit() for c in w) and max(map(len, w.split("."))) <= 2)
            kind = "mixed" if short or dots else "ends"
        elif kind == "ends" and len(w) == 1 and w.isalpha() and w.isupper():
            kind = "mixed"
        if kind == "never" or (key == "##" and self.m.period(lang, f"##.|{head(token.lstrip(OPENERS))}") == "never"):
            return False
        if kind == "mixed":
            return self._starts(token, rest, True)
        if dots:
            return self._starts(token, rest, False)
        return True

    def _closed(self, line: str, begin: int, o: int, c: int) -> bool:
        """Whether a sentence ends with the mark that closes line[o:c+1], which holds an end mark before it."""
        if line[o] in BRACKETS:
            return not any(x.isalnum() for x in line[begin:o])
        rest = line[c + 1 : c + 61]
        nxt = WORDS.search(line, c + 1)
        if nxt is None:
            return True
        token = nxt.group()
        intro = line[begin:o].rstrip()[-1:]
        told = intro in (":", "：", ",", "،", "，") and intro != ""
        if token[0] in ",;:،؛，、—–-" or token[0] in END:
            return False
        first = token.lstrip(OPENERS)[:1]
        if first and first.isalpha() and cased(first):
            if not rest[:1].isspace() and not first.isupper():
                return False
            return self._starts(token, rest, self.low)
        if first and first.isalpha():
            return told
        return told or (token[0] in OPENERS and rest[:1].isspace())

    def line(self, at: int, end: int) -> list[tuple[int, int]]:
        """Sentences of text[at:end], which has no line break, as offsets into the text."""
        line = self.text[at:end]
        # only a digit, a bullet, white space or a letter before . or ) can begin a list mark
        mark = None if line[0].isalpha() and line[1:2] not in (".", ")") else MARK.match(line)
        begin = 0
        body = mark.end() if mark else 0
        spans = _spans(line) if self.marked and MARKS.search(line) else ()
        opens = {o for o, _ in spans}
        s = 0
        cuts: list[int] = []
        pos = 0
        for m in self.events.finditer(line):
            i, j = m.span()
            if i < pos:
                continue
            if spans:
                while s < len(spans) and spans[s][1] < i:
                    s += 1
                if s < len(spans) and spans[s][0] < i < spans[s][1]:
                    continue
            c = line[i]
            head = max(begin, body) if begin == 0 else begin
            if c.isspace():
                cuts.append(i)
                begin = j
                continue
            if c not in END:
                if s < len(spans) and spans[s][1] == i:
                    o = spans[s][0]
                    inner = line[o + 1 : i].rstrip()
                    if inner and inner[-1] in END and self._closed(line, head, o, i):
                        cuts.append(i + 1)
                        begin = i + 1
                continue
            if mark and i < body:
                continue
            run = line[i:j]
            while j < len(line) and line[j] in CLOSERS and j not in opens:
                j += 1
            if run == "." or not run.strip(DOTS):
                ends = self._period(line, head, i, j)
            else:
                ends = self._strong(line, j)
            if ends:
                cuts.append(j)
                begin, pos = j, j
        out, a = [], 0
        for b in (*cuts, len(line)):
            part = line[a:b].rstrip()
            if part:
                z = at + a + len(part)
                out.append((z - len(part.lstrip()), z))
            a = b
        return out

    def _strong(self, line: str, j: int) -> bool:
        """Whether an exclamation, question or full stop of another script ends a sentence at j."""
        rest = line[j : j + 2]
        nxt = WORDS.search(line, j)
        if nxt is None:
            return True
        c = nxt.group()[0]
        if c in ",;:،؛，、" or c in "—–":
            return False
        if rest[0].isspace() or line[j - 1] not in "!?":
            return True
        return not (c.isascii() and (c.islower() or c.isdigit() or c in "=&/_"))


def split(text: str | None, model: Model, lang: str | None = None, low: bool | None = None) -> list[tuple[int, int]]:
    """The sentences of a text as half-open offsets in code points; none for null, empty and blank texts.

    `lang` and `low` (whether sentences begin in lower case) are told from the text if not given.
    """
    if not text:
        return []
    s = Splitter(model, text, lang, low)
    out = []
    for m in LINES.finditer(text):
        out += s.line(*m.span())
    return out


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence of every document, by a model of the same documents unless one is given."""
    tells = model or languages(documents)
    rows = _prepared(documents, tells, model is None)
    shipped = documents.sparkSession.sparkContext.broadcast(model or learn(rows, tells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            ids, starts, ends = [], [], []
            for d, t, lang, low in zip(*(b.column(i).to_pylist() for i in range(4))):
                if found := split(t, m, lang, low):
                    ids += [d] * len(found)
                    a, z = zip(*found)
                    starts += a
                    ends += z
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "sent_start", "sent_end"])

    return rows.where("what = 'doc'").select("doc_id", "text", "lang", "low").mapInArrow(_uncollected(run), "doc_id long, sent_start int, sent_end int")
