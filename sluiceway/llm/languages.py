"""Languages of documents and of their stretches (problem 10).

A text is cut into sentences. Each word of a sentence is scored by its log frequency in each
language; a word that the model doesn't know falls back to its character n-grams, longest first,
down to single characters. Adjacent sentences of one language form a segment with a confidence.

The model is fitted on a bounded sample of documents whose label names a language; since labels are
partly wrong, the sample's sentences are labelled anew by the first fit, and counted again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passes import map_batches

#: Sampled documents for each language, the longest document in the sample (characters), and words kept a language.
SAMPLE_DOCS, SAMPLE_CHARS, MOST_WORDS = 400, 20_000, 20_000
#: Documents that must bear a language's label for it to be learnt. Languages are at most those of ``CODES``.
LEAST_DOCS = 3
#: What a stretch is called whose words are strange to every language learnt, and the share of known word parts below which they are.
UNKNOWN, LEAST_KNOWN = "und", 0.45
#: Longest n-gram of the backoff.
NGRAM = 4
#: Least words of a whole sentence, and least lead of its language over the next (log units) to stand by itself.
LEAST_WORDS, LEAST_LEAD = 3, 2.0
#: Least lead of the language of a sentence's first and last two words to count as its frame.
FRAME_LEAD = 1.0
#: Whole sentences that make a language one of the document's.
LEAST_SENTENCES = 2

# ISO 639-1 code, ISO 639-2 codes and English name of languages.
_NAMES = """
en eng english|de deu ger german|fr fra fre french|es spa spanish castilian|pt por portuguese|it ita italian|nl nld dut dutch flemish|sv swe swedish|pl pol polish|ru rus russian|
da dan danish|no nor norwegian nob nno nb nn|fi fin finnish|is isl ice icelandic|cs ces cze czech|sk slk slo slovak|sl slv slovenian|hr hrv croatian|sr srp serbian|bs bos bosnian|
bg bul bulgarian|mk mkd mac macedonian|uk ukr ukrainian|be bel belarusian|ro ron rum romanian|hu hun hungarian|el ell gre greek|tr tur turkish|sq sqi alb albanian|lt lit lithuanian|
lv lav latvian|et est estonian|ca cat catalan|gl glg galician|eu eus baq basque|ga gle irish|cy cym wel welsh|la lat latin|ar ara arabic|he heb hebrew|fa fas per persian|hi hin hindi|
bn ben bengali|ur urd urdu|ta tam tamil|te tel telugu|ja jpn japanese|ko kor korean|zh zho chi chinese|vi vie vietnamese|th tha thai|id ind indonesian|ms msa may malay|sw swa swahili
"""
CODES = {alias: names[0] for names in (x.split() for x in _NAMES.replace("\n", "").split("|")) for alias in names}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?…。]+[\"”’»)\]]*(?=\s|$)|\n")


def label_code(label: str | None) -> str | None:
    """Two-letter code of the language that a label names, by a code, a region form or its English name; None if none."""
    if label is None:
        return None
    s = label.strip().lower()
    return CODES.get(s) or CODES.get(re.split(r"[-_ (,;/.@]", s, maxsplit=1)[0]) if s else None


def label_code_column(label: Column) -> Column:
    """``label_code`` as a column expression."""
    s = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), F.try_element_at(table, F.split(s, r"[-_ (,;/.@]")[0]))


def sentences(text: str) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, words in lower case, whether it ends like a sentence) of the sentences of a text."""
    out = []
    words: list[str] = []
    start = end = 0
    for m in _TOKEN.finditer(text):
        w = m.group()
        if w[0].isalpha():
            if not words:
                start = m.start()
            words.append(w.lower())
            end = m.end()
        else:
            if words:
                closed = w != "\n"
                out.append((start, m.end() if closed else end, words, closed))
                words = []
    if words:
        out.append((start, end, words, False))
    return out


@dataclass
class Model:
    """Word and n-gram scores of each language: rows of log probabilities, relative to the best language."""

    langs: list[str]
    words: dict[str, int]
    table: np.ndarray
    grams: list[dict[str, int]]
    gram_tables: list[np.ndarray]

    def unseen(self, word: str) -> tuple[np.ndarray, float]:
        """Scores of an unknown word, the mean over its known n-grams of the greatest length that has any; and that length times the share of the n-grams known, over ``NGRAM``."""
        padded = f"^{word}$"
        for n in range(NGRAM, 0, -1):
            known = self.grams[n - 1]
            rows = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if rows:
                return self.gram_tables[n - 1][rows].mean(axis=0), n / NGRAM * len(rows) / max(1, len(padded) - n + 1)
        return np.zeros(len(self.langs), dtype=np.float32), 0.0


def _scores(counts: list[Counter], keys: list[str], add: float) -> np.ndarray:
    total = np.array([sum(c.values()) for c in counts], dtype=float)
    m = np.array([[c.get(k, 0) for c in counts] for k in keys], dtype=float).reshape(len(keys), len(counts))
    p = (m + add) / (total + add * max(len(keys), 1))
    s = np.log(p)
    s -= s.max(axis=1, keepdims=True) if len(keys) else 0
    return np.maximum(s, -7.0).astype(np.float32)


def fit(sample: list[tuple[str, str]], rounds: int = 2) -> Model:
    """Fit on (language, text) pairs whose labels may be wrong: later rounds count sentences as the fit before reads them.

    A sentence that is read as another language than its document's label is counted for the
    language read if it leads clearly, else dropped.
    """
    langs = sorted({la for la, _ in sample})
    at = {la: i for i, la in enumerate(langs)}
    sents = [(at[la], s[2]) for la, t in sample for s in sentences(t)]
    given = [i for i, _ in sents]
    model = None
    for _ in range(rounds):
        counts = [Counter() for _ in langs]
        for i, (_, ws) in zip(given, sents, strict=True):
            if i is not None:
                counts[i].update(ws)
        keep = sorted({w for c in counts for w, n in c.most_common(MOST_WORDS) if n > 1})
        grams = [[Counter() for _ in langs] for _ in range(NGRAM)]
        for i, c in enumerate(counts):
            for w, n in c.items():
                p = f"^{w}$"
                k = 1 + int(math.log2(n))  # frequent words must not drown the rest
                for g in range(1, NGRAM + 1):
                    for j in range(len(p) - g + 1):
                        grams[g - 1][i][p[j : j + g]] += k
        gram_keys = [sorted({x for c in gs for x, n in c.items() if n > 1}) for gs in grams]
        model = Model(
            langs, {w: i for i, w in enumerate(keep)}, _scores(counts, keep, 0.5),
            [{g: i for i, g in enumerate(ks)} for ks in gram_keys], [_scores(gs, ks, 0.5) * 0.5 for gs, ks in zip(grams, gram_keys, strict=True)],
        )
        if langs:
            scores = Scorer(model).sums([ws for _, ws in sents])
            best = scores.argmax(axis=1)
            lead = _lead(scores)
            given = [int(b) if b == i or x > 2 * LEAST_LEAD else None for (i, _), b, x in zip(sents, best, lead, strict=True)]
    return model


def _lead(scores: np.ndarray) -> np.ndarray:
    if not len(scores):
        return np.zeros(0)
    if scores.shape[1] < 2:
        return np.full(len(scores), 99.0)
    two = np.partition(scores, -2, axis=1)
    return two[:, -1] - two[:, -2]


class Scorer:
    """Sums of word scores, with the rows of words met so far kept in one growing table."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.row = dict(self.model.words)
        self.table = self.model.table
        self.known = np.ones(len(self.table), dtype=np.float32)
        if not len(self.table):
            self.table = np.zeros((0, len(self.model.langs)), dtype=np.float32)

    def sums(self, sents: list[list[str]]) -> np.ndarray:
        """One row of scores for each list of words.

        A list whose first two and last two words clearly agree on another language than the sum
        quotes a phrase: it gets the scores of its frame, the four words, in place of the sum.
        ``shares`` then holds how well each list's words are known, from 0 to 1.
        """
        flat = [w for ws in sents for w in ws]
        if len(self.row) > 300_000:
            self._reset()
        new = {w for w in flat if w not in self.row}
        if new:
            n = len(self.table)
            self.row.update((w, n + i) for i, w in enumerate(new))
            got = [self.model.unseen(w) for w in new]
            self.table = np.concatenate([self.table, np.array([s for s, _ in got], dtype=np.float32)])
            self.known = np.concatenate([self.known, np.array([k for _, k in got], dtype=np.float32)])
        ids = np.fromiter(map(self.row.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.array([len(ws) for ws in sents], dtype=np.int64)
        out = np.zeros((len(sents), len(self.model.langs)), dtype=np.float32)
        self.shares = np.ones(len(sents), dtype=np.float32)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            self.shares[full] = np.add.reduceat(self.known[ids], starts) / sizes[full]
            rows = self.table[ids]
            total = np.add.reduceat(rows, starts, axis=0)
            if out.shape[1] > 1:
                n = sizes[full]
                last = starts + n - 1
                head = rows[starts] + rows[np.minimum(starts + 1, last)]
                tail = rows[last] + rows[np.maximum(last - 1, starts)]
                a, b = head.argmax(axis=1), tail.argmax(axis=1)
                frame = (a == b) & (a != total.argmax(axis=1)) & (n >= 6) & (_lead(head) >= FRAME_LEAD) & (_lead(tail) >= FRAME_LEAD)
                total[frame] = head[frame] + tail[frame]
            out[full] = total
        return out


def fit_on(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on about ``sample_docs`` documents of each labelled language (of at most ``SAMPLE_CHARS`` characters), picked by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), label_code_column(F.col(label_col)).alias("l")).filter(f"l IS NOT NULL AND length(t) BETWEEN 1 AND {SAMPLE_CHARS}")
    counted = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] >= LEAST_DOCS}
    if not counted:
        return fit([])
    chance = F.create_map(*[F.lit(x) for la, n in counted.items() for x in (la, min(1.0, sample_docs / n))])
    picked = rows.filter(F.col("l").isin(sorted(counted)) & (F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < F.try_element_at(chance, "l") * 1_000_000))
    got = [(r["l"], r["t"]) for r in picked.select("id", "l", "t").distinct().orderBy("id").limit(2 * sample_docs * len(counted)).collect()]
    return fit(got)


def _read(scores: np.ndarray, wholes: list[bool], known: np.ndarray) -> list[tuple[int, float, bool]]:
    """(language, lead, whole) of the sentences of one document; unclear ones take the nearest clear one's language, strange ones have -1."""
    best = scores.argmax(axis=1).tolist()
    lead = _lead(scores).tolist()
    clear = [i for i, x in enumerate(lead) if x >= LEAST_LEAD]
    if clear and len(clear) < len(best):
        k = 0
        for i in range(len(best)):
            if lead[i] >= LEAST_LEAD:
                continue
            while k + 1 < len(clear) and abs(clear[k + 1] - i) <= abs(clear[k] - i):
                k += 1
            best[i] = best[clear[k]]
    for i in np.flatnonzero(known < LEAST_KNOWN).tolist():
        best[i] = -1
    return list(zip(best, lead, wholes, strict=True))


_SEGMENTS = "doc_id bigint, segment int, start bigint, end bigint, lang string, confidence double, n_sentences int"


def segments(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """Stretches of one language of each document, in order.

    ``doc_id, segment, start, end, lang, confidence, n_sentences``: ``start`` and ``end`` are
    character offsets, ``n_sentences`` counts whole sentences. ``confidence`` is the probability of
    the language given the words' scores, tempered by the segment's length. A stretch whose words are
    strange to all languages learnt is ``und``, with the share of what is strange. Null and wordless texts
    give no rows; with no labelled document to learn from there are none at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_WORDS a language

    def make():
        scorer = Scorer(shared.value)
        langs = shared.value.langs

        def batch(ids, texts):
            out: list[list] = [[] for _ in range(7)]
            if not langs:
                return out
            per = [sentences(t) if t else [] for t in texts]
            flat = [s for ss in per for s in ss]
            sums = scorer.sums([s[2] for s in flat])
            known = scorer.shares
            lo = 0
            for i, ss in zip(ids, per, strict=True):
                hi = lo + len(ss)
                if i is None or not ss:
                    lo = hi
                    continue
                own = sums[lo:hi]
                read = _read(own, [s[3] and len(s[2]) >= LEAST_WORDS for s in ss], known[lo:hi])
                seg = 0
                a = 0
                while a < len(ss):
                    b = a
                    while b + 1 < len(ss) and read[b + 1][0] == read[a][0]:
                        b += 1
                    total = own[a : b + 1].sum(axis=0)
                    words = sum(len(s[2]) for s in ss[a : b + 1])
                    z = total / math.sqrt(max(words, 1))
                    p = np.exp(z - z.max())
                    at = read[a][0]
                    conf = float(p[at] / p.sum()) if at >= 0 else float(1 - known[lo + a : lo + b + 1].mean())
                    for o, v in zip(out, (i, seg, ss[a][0], ss[b][1], langs[at] if at >= 0 else UNKNOWN, round(conf, 6), sum(r[2] for r in read[a : b + 1])), strict=True):
                        o.append(v)
                    seg += 1
                    a = b + 1
                lo = hi
            return out

        return batch

    return map_batches(docs.select(F.col(id_col).cast("bigint"), text_col), make, _SEGMENTS, scan=True)


def document_languages(segs: DataFrame) -> DataFrame:
    """``doc_id, lang, share, confidence, n_sentences``: each language of a document with its share of the text."""
    per = segs.groupBy("doc_id", "lang").agg(
        F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum("n_sentences").cast("int").alias("n_sentences"),
        F.sum((F.col("end") - F.col("start")) * F.col("confidence")).alias("weighted"),
    )
    whole = per.groupBy("doc_id").agg(F.sum("chars").alias("all_chars"))
    return per.join(whole, "doc_id").select("doc_id", "lang", F.round(F.col("chars") / F.col("all_chars"), 6).alias("share"), F.round(F.col("weighted") / F.col("chars"), 6).alias("confidence"), "n_sentences")


def unnamed_languages(docs: DataFrame, id_col: str, text_col: str, label_col: str, model: Model) -> DataFrame:
    """``doc_id, lang``: languages with at least ``LEAST_SENTENCES`` whole sentences that the document's label doesn't name; distinct. Unknown languages have no code and are left out."""
    per = segments(docs, id_col, text_col, model).groupBy("doc_id", "lang").agg(F.sum("n_sentences").alias("n")).filter((F.col("n") >= LEAST_SENTENCES) & (F.col("lang") != UNKNOWN))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), label_code_column(F.col(label_col)).alias("lang")).filter("lang IS NOT NULL").distinct()
    return per.select("doc_id", "lang").join(named, ["doc_id", "lang"], "left_anti").distinct()
