"""Subject areas of documents: labelling functions over paragraphs, joined by a latent model that learns how far to trust each.

The functions vote per paragraph and subject, or abstain:
* terms: two different phrases of the subject's seed lexicon (or of its lexicon in the sentence's own language) in sentences that
  speak of something, told from set phrases of the page by a word model;
* words: a sentence with several words that, in the collection, keep to paragraphs of the subject;
* section: a heading that names a term of the subject, over a paragraph with one;
* address: a link, mail address or path in the paragraph that names a term of the subject;
* source: a source most of whose documents deal with the subject, for paragraphs that another function votes on.
Words are counted over all documents in the paragraphs the lexicon alone is sure about, so that the collection and not the lexicon
says which words speak for a subject, and which of the lexicon's don't. Each task adds up what it has and the sums meet by class
and word; words below ``LEAST`` and ``FLOOR`` stay with the executors, so the learned tables that are broadcast hold at most a
sentence's words over ``FLOOR``. Votes are cast once for every document and kept as narrow rows, for the source shares, the
accuracies and the posteriors that follow. Hand labels, where given, bound how often a function may vote falsely.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Set
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.lexicon import FIGURES, OTHER, TERMS, terms
from treeloom.llm.winners import hash_sample
from treeloom.session import BROADCAST_ROWS, materialize

#: A word speaks for anything from this count and this share of all sentences on. Counts that a task holds before it passes them on.
LEAST, FLOOR, HELD = 5, 1e-6, 200_000
#: A word keeps to a subject from this log ratio over any other class on; a sentence needs two such words and this sum of ratios,
#: of which one counts up to the cap.
KEEPS, KEPT_SUM, KEPT_CAP = 0.7, 4.5, 3.5
#: False votes of a function per paragraph and subject at most, where no hand labels bound them.
FALSE = 0.02
#: A source speaks for a subject from this many documents and this share of them on.
SOURCE_DOCUMENTS, SOURCE_SHARE = 20, 0.5
#: Hand labels that are read at most (chosen by hash); they bound false votes only.
LABELLED = 20_000

_FENCE = re.compile(r"^[ \t>]*(?:[-*] )?(```|~~~).*?(?:^[ \t>]*\1[ \t]*$|\Z)", re.S | re.M)
_CODE_LINE = re.compile(r"^(?: {4,}|\t).*$|^> .*[=(){};].*$|^.*[;{}]\s*$", re.M)
#: Without it, and without tabs, runs of spaces and quotes, no line is code.
_CODE_END = re.compile(r"[;{}]\s*$", re.M)
_TICKS = re.compile(r"`[^`\n]*`")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
#: The sign that ends a sentence, with the space behind it, or a line's end.
_SENTENCE = re.compile(r"([.!?\n])(?:(?<=\n)|\s+)")
_WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: Bytes of lower-case ASCII as they are, anything else as a space.
_LETTERS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\w/.])(?:[\w.-]+/){2,}[\w.-]*")
_FUNCTIONS = ("terms", "words", "section", "address", "source")
#: The votes of the functions that read a text, as one number; the vote of the source is added to it afterwards.
_SOURCE_BIT, _PATTERNS = 1 << 4, range(1 << 5)


def paragraphs(text: str) -> list[tuple[str, list[str], list[str]]]:
    """(heading, sentences, addresses) of each paragraph of prose; code, quoted code and inline code are left out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "\t" in text or "    " in text or "> " in text or (";" in text or "{" in text or "}" in text) and _CODE_END.search(text):
        text = _CODE_LINE.sub("", text)
    out, heading = [], ""
    for p in _PARAGRAPH.split(_TICKS.sub(" ", text)):
        lines = p.strip()
        if not lines:
            continue
        if lines.startswith("#"):
            first, _, lines = lines.partition("\n")
            heading = first.lstrip("# ")
        if lines.strip():
            links = _ADDRESS.findall(lines) if "/" in lines or "@" in lines or "www." in lines else []
            for x in links:
                lines = lines.replace(x, " ")
            parts = _SENTENCE.split(lines)
            ended = [s if end == "\n" else s + end for s, end in zip(parts[::2], parts[1::2])]
            out.append((heading, [s for s in (*ended, parts[-1]) if s and not s.isspace()], links))
    return out


def plain_words(low: str) -> list[str]:
    """What _WORDS finds in a lower-case text; ASCII without a sign that joins words is only split."""
    if not low.isascii() or "'" in low or "-" in low:
        return _WORDS.findall(low)
    return low.encode().translate(_LETTERS).decode().split()


def _forms(phrase: str):
    yield phrase
    if phrase.endswith("y") and phrase[-2] not in "aeiou":
        yield phrase[:-1] + "ies"
    elif phrase.endswith(("s", "x", "ch", "sh")):
        yield phrase + "es"
    else:
        yield phrase + "s"


#: Each turn of speech under its longest plain word: a sentence with that word is searched for the turn.
_FIGURE_AT: dict[str, re.Pattern] = {}
for _f in FIGURES:
    _plain = [w for w in re.findall(r"(?<![a-z'(|])[a-z]{2,}(?![a-z'|)?])", re.sub(r"\\\w|\([^)]*\)\??", " ", _f))]
    _w = max(_plain, key=lambda w: (w != "the", len(w)))
    _FIGURE_AT[_w] = re.compile(f"{_FIGURE_AT[_w].pattern}|(?:{_f})" if _w in _FIGURE_AT else f"(?:{_f})")

_FIGURE_WORDS = frozenset(_FIGURE_AT)


class Lexicon:
    """Phrases by their first word, with the languages of single words; ``weak`` (subject, phrase) are left out."""

    def __init__(self, weak: Set[tuple[str, str]] = frozenset()):
        self.first: dict[str, list[tuple[tuple[str, ...], tuple[str, ...], str]]] = defaultdict(list)
        for phrase, subjects in terms().items():
            subjects = tuple(s for s in subjects if (s, phrase) not in weak)
            for form in _forms(phrase) if subjects else ():
                words = tuple(form.split())
                self.first[words[0]].append((words, subjects, phrase))
        for v in self.first.values():
            v.sort(key=lambda x: -len(x[0]))
        self.marks = {lang: set(marks.split()) for lang, (marks, _) in OTHER.items()}
        self.other: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for lang, (_, by) in OTHER.items():
            for subject, ws in by.items():
                for w in ws.split():
                    for form in _forms(w):
                        self.other[form].append((lang, subject))
        self.foreign = frozenset(self.other)
        self.known = frozenset(self.first) | self.foreign
        #: By first word: the second words of longer phrases; what it says where none of them is in the sentence.
        self.second = {w: frozenset(p[1] for p, _, _ in v if len(p) > 1) for w, v in self.first.items() if len(v[0][0]) > 1}
        self.alone = {w: [(s, x[2]) for s in x[1]] for w, v in self.first.items() if (x := next((x for x in v if len(x[0]) == 1), None))}

    def read(self, sentence: str) -> tuple[list[tuple[str, str]], set[str]]:
        """((subject, term) found, the words of the terms) of a sentence, turns of speech left out."""
        return self.match(self.words(sentence))

    def words(self, sentence: str) -> list[str]:
        low = sentence.lower()
        words = plain_words(low)
        if not _FIGURE_WORDS.isdisjoint(words):
            whole = low
            for t in _FIGURE_WORDS.intersection(words):
                low = _FIGURE_AT[t].sub(" ", low)
            if low != whole:
                words = plain_words(low)
        return words

    def match(self, words: list[str]) -> tuple[list[tuple[str, str]], set[str]]:
        found: list[tuple[str, str]] = []
        used: set[str] = set()
        known = self.known.intersection(words)
        if not known:
            return found, used
        second, alone = self.second, self.alone
        for w in known:
            if w in second and not second[w].isdisjoint(words):
                self._phrases(words, found, used)
                break
        else:
            for w in known if len(known) == 1 else words:  # in their order, which settles ties of classes
                if w in alone:
                    found += alone[w]
                    used.add(w)
        if not self.foreign.isdisjoint(known):
            spoken: dict[str, bool] = {}
            for w in self.foreign.intersection(words):
                for lang, subject in self.other[w]:
                    if lang not in spoken:
                        marks = self.marks[lang].intersection(words)
                        spoken[lang] = len(marks) > 1 or sum(map(words.count, marks)) > 1
                    if spoken[lang]:
                        found.append((subject, w))
        return found, used

    def _phrases(self, words: list[str], found: list[tuple[str, str]], used: set[str]) -> None:
        first, free = self.first, 0
        for i in [i for i, w in enumerate(words) if w in first]:
            if i < free:
                continue
            for phrase, subjects, term in first[words[i]]:
                n = len(phrase)
                if n == 1 or tuple(words[i : i + n]) == phrase:
                    found += [(s, term) for s in subjects]
                    used.update(phrase)
                    free = i + n
                    break


class Model:
    """The learned tables: how much a word speaks for page phrases, and which words keep to a subject."""

    def __init__(self):
        self.talk: dict[str, float] = {}
        self.keeps: dict[str, tuple[str, float]] = {}
        self.weak: set[tuple[str, str]] = set()
        self._words: tuple[frozenset[str], frozenset[str]] | None = None

    def words(self) -> tuple[frozenset[str], frozenset[str]]:
        """The words of ``talk`` and of ``keeps``."""
        if self._words is None:
            self._words = frozenset(self.talk), frozenset(self.keeps)
        return self._words


def votes(text: str, lex: Lexicon, model: Model) -> list[dict[str, int]]:
    """For each paragraph: subject -> votes of the functions that read a text, as bits in the order of _FUNCTIONS.

    ``lex`` is the lexicon without the model's weak terms; subjects without a vote are absent.
    """
    out = []
    talk, keeps = model.talk, model.keeps
    talking, keeping = model.words()
    read, named = "", set()
    for heading, sentences, links in paragraphs(text):
        seen: dict[str, set] = defaultdict(set)
        by_words, touched = set(), set()
        for s in sentences:
            words = lex.words(s)
            found, used = lex.match(words)
            kept = keeping.intersection(words)
            if not found and not kept:
                continue
            strong = False
            if kept:
                sums: dict[str, float] = {}
                for w in kept:
                    subject, weight = keeps[w]
                    sums[subject] = sums.get(subject, 0.0) + weight
                if len(sums) > 1:
                    subject = max(sums, key=sums.get)
                touched.add(subject)
                strong = sums[subject] >= KEPT_SUM and sum(keeps[w][0] == subject for w in kept) > 1
            if (found or strong) and sum(map(talk.__getitem__, talking.intersection(words) - used)) > -1.0:
                for x, term in found:
                    seen[x].add(term)
                if strong:
                    by_words.add(subject)
        if not (seen or touched or links):
            out.append({})
            continue
        if heading != read:
            read, named = heading, {subject for subject, _ in lex.read(heading)[0]} if heading else set()
        linked = {subject for x in links for subject, _ in lex.read(re.sub(r"[\W_]+", " ", x))[0]}
        bits, taken = {}, set()
        for s in sorted(seen, key=lambda x: (-len(seen[x]), x)):  # a word of two fields is evidence for the one with more of them
            seen[s] = seen[s] - taken
            taken |= seen[s]
        for s in seen.keys() | touched | linked:
            v = (len(seen.get(s, ())) >= 2) | (s in by_words) << 1 | (s in named and (s in seen or s in touched)) << 2 | (s in linked) << 3
            if v:
                bits[s] = v
        out.append(bits)
    return out


def count_words(text: str, lex: Lexicon, counts: dict[str, Counter]) -> None:
    """Add the sentences of paragraphs the lexicon alone is sure about: class -> counts of words, of sentences under the word ""."""
    for _, sentences, _ in paragraphs(text):
        read = [lex.words(s) for s in sentences]
        found = dict.fromkeys(chain.from_iterable(lex.match(words)[0] for words in read))
        met: dict[str, int] = {}
        for subject, _ in found:
            met[subject] = met.get(subject, 0) + 1
        best = max(met, key=met.get) if met else ""
        most = met.get(best, 0)
        name = best if most >= 3 else "none" if most <= 1 else None
        if name:
            of = counts[name]
            of.update(chain.from_iterable(map(set, read)))
            of[""] += len(read)


def word_tables(counts: dict[tuple[str, str], int]) -> tuple[Model, list[str]]:
    """The word tables of a model, and the subjects met, from (class, word) counts."""
    model = Model()
    of: dict[str, Counter] = defaultdict(Counter)
    sizes: Counter = Counter()
    for (name, w), n in counts.items():
        if w:
            of[name][w] = n
        else:
            sizes[name] = n
    subjects = sorted(s for s in sizes if s != "none")
    if not subjects or not sizes["none"]:
        return model, []
    about: Counter = Counter()
    for s in subjects:
        about.update(of[s])
    fields = terms()
    n_about, n_none = sum(sizes[s] for s in subjects), sizes["none"]
    for w, n in (about + of["none"]).items():
        if n < LEAST:
            continue
        p, q = (about[w] + 0.5) / (n_about + 1), (of["none"][w] + 0.5) / (n_none + 1)
        lean = max(-2.0, min(1.0, math.log(p / q)))
        if abs(lean) > 0.2:
            model.talk[w] = lean
        rates = sorted(((of[s][w] + 0.5) / (sizes[s] + 50), s) for s in subjects)
        top, rival = rates[-1], rates[-2][0] if len(rates) > 1 else 0.0
        weight = math.log(top[0] / max(rival, (of["none"][w] + 0.5) / (n_none + 50)))
        for s in fields.get(w, ()):
            if s in sizes and math.log((of[s][w] + 0.5) / (sizes[s] + 50) / ((of["none"][w] + 0.5) / (n_none + 50))) < KEEPS:
                model.weak.add((s, w))
        if len(w) > 2 and weight >= KEEPS and of[top[1]][w] >= 4:
            model.keeps[w] = (top[1], min(KEPT_CAP, weight))
    return model, subjects


def accuracies(patterns: Counter, most: list[float] | None = None, rounds: int = 60) -> list[float]:
    """Posterior of the subject for every pattern of votes: a two-class model with independent functions, fitted by EM.

    A latent model knows its classes only by the functions; they are told apart by where it starts, and by ``most``, the rates of
    false votes per function that hand labels allow (``FALSE`` without labels). Everything else is free.
    """
    m = len(_FUNCTIONS)
    most = most or [FALSE] * m
    prior, hit, false = 0.05, [0.8, 0.8, 0.1, 0.1, 0.2], [x / 2 for x in most]

    def posterior(v: int) -> float:
        a, b = prior, 1 - prior
        for k in range(m):
            a *= hit[k] if v >> k & 1 else 1 - hit[k]
            b *= false[k] if v >> k & 1 else 1 - false[k]
        return a / (a + b)

    for _ in range(rounds if sum(patterns.values()) else 0):
        weight = {v: posterior(v) for v in patterns}
        yes = sum(n * weight[v] for v, n in patterns.items())
        no = sum(n * (1 - weight[v]) for v, n in patterns.items())
        if yes < 1 or no < 1:
            break
        prior = yes / (yes + no)
        for k in range(m):
            hit[k] = (sum(n * weight[v] * (v >> k & 1) for v, n in patterns.items()) + 0.5) / (yes + 1)
            false[k] = min(most[k], (sum(n * (1 - weight[v]) * (v >> k & 1) for v, n in patterns.items()) + 0.5) / (no + 1))
    return [posterior(v) for v in _PATTERNS]


def _counted(docs: DataFrame) -> DataFrame:
    """(name, word, n) of all texts: sums of each task, then of all."""
    names = ("name", "word", "n")

    def batch(counts: dict[str, Counter]) -> pa.RecordBatch:
        keys = [(name, w, n) for name, of in counts.items() for w, n in of.items() if len(w) > 2 or not w]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names)

    def run(batches):
        lex, counts = Lexicon(), defaultdict(Counter)
        for b in batches:
            for t in b.column(0):
                count_words(t.as_py(), lex, counts)
            if sum(map(len, counts.values())) >= HELD:
                yield batch(counts)
                counts = defaultdict(Counter)
        yield batch(counts)

    return docs.where("text is not null").select("text").mapInArrow(run, "name string, word string, n long").groupBy("name", "word").agg(F.sum("n").alias("n"))


def _word_counts(docs: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of the words met ``LEAST`` times and in ``FLOOR`` of all sentences, whatever their classes; of the sentences always."""
    counted = materialize(_counted(docs), "word-counts")
    sentences = counted.where("word = ''").agg(F.sum("n")).first()[0] or 0
    by_word = counted.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("name", "n")).alias("by"))
    return {(c["name"], r["word"]): c["n"] for r in by_word.where((F.col("all") >= max(LEAST, FLOOR * sentences)) | (F.col("word") == "")).toLocalIterator() for c in r["by"]}


def _cast(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, subject, pattern, n, lead): how many paragraphs had a pattern of votes; one of a subject's rows leads.

    A document has also one row without subject, of which n counts its paragraphs.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)
    shape = [("doc_id", pa.int64()), ("source", pa.string()), ("subject", pa.string()), ("pattern", pa.int32()), ("n", pa.int32()), ("lead", pa.int32())]

    def run(batches):
        m = model.value
        lex = Lexicon(m.weak)
        for b in batches:
            out: list[tuple] = []
            for d, source, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                had: Counter = Counter()
                by_paragraph = votes(t, lex, m) if t else []
                for bits in by_paragraph:
                    had.update(bits.items())
                led: set[str] = set()
                for (s, v), n in had.items():
                    out.append((d, source, s, v, n, int(s not in led)))
                    led.add(s)
                out.append((d, source, None, None, len(by_paragraph), 1))
            cols = list(zip(*out, strict=True)) or [[] for _ in shape]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, shape, strict=True)], [n for n, _ in shape])

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text").mapInArrow(run, "doc_id long, source string, subject string, pattern int, n int, lead int")


def _false_rates(kept: DataFrame, labels: DataFrame, subjects: int) -> list[float] | None:
    """Upper bounds of false votes per paragraph and subject, from documents labelled by hand; None without labels."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "subject").where("doc_id is not null and subject is not null")
    named = F.broadcast(hash_sample(rows, "doc_id", LABELLED, rows.count()).groupBy("doc_id").agg(F.collect_set("subject").alias("names")))
    j = kept.join(named, "doc_id").withColumn("wrong", ~F.array_contains("names", F.col("subject")))
    bits = [F.sum(F.when(F.col("wrong") & (F.col("pattern").bitwiseAND(1 << k) != 0), F.col("n")).otherwise(0)).alias(f) for k, f in enumerate(_FUNCTIONS)]
    r = j.agg(*bits, F.sum(F.when(F.col("subject").isNull(), F.col("n") * (subjects - F.size("names")))).alias("pairs")).first()
    if not r["pairs"]:
        return None
    return [min(0.2, (r[f] + 2 * math.sqrt(r[f]) + 3) / (r["pairs"] + 3)) for f in _FUNCTIONS]


def document_subjects(docs: DataFrame, subjects: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, subject, posterior): each subject of ``subjects`` that at least one paragraph of the document deals with.

    docs: (doc_id, text[, source]); labels: (doc_id, subject) by hand. The posterior is the highest of its paragraphs. Null, empty and
    subjectless texts give no row; repeated rows of a document count as one; texts of any length are read whole. Subjects without
    a lexicon here get no documents. A null source speaks for nothing, and no source decides alone.
    """
    known = subjects.select("subject").where(F.col("subject").isin(*TERMS)).distinct()  # as many as there are lexicons
    model, met = word_tables(_word_counts(docs))
    kept = materialize(_cast(docs, model), "votes")
    per = kept.where("subject is null and source is not null").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("paragraphs"))
    speak = kept.where("subject is not null and source is not null").groupBy("source", "subject").agg(F.sum("lead").alias("leads")).join(per, "source")
    speak = materialize(speak.where((F.col("docs") >= SOURCE_DOCUMENTS) & (F.col("leads") >= SOURCE_SHARE * F.col("docs"))).select("source", "subject", "paragraphs"), "sources")
    said = F.broadcast if speak.count() <= BROADCAST_ROWS else (lambda x: x)
    kept = kept.join(said(speak.select("source", "subject", F.lit(_SOURCE_BIT).alias("bit"))), ["source", "subject"], "left")
    kept = kept.withColumn("pattern", F.col("pattern") + F.coalesce("bit", F.lit(0)))
    counts = Counter({r[0]: r[1] for r in kept.groupBy("pattern").agg(F.sum("n")).collect()})
    total = counts.pop(None, 0)
    quiet = (speak.agg(F.sum("paragraphs")).first()[0] or 0) - sum(n for v, n in counts.items() if v & _SOURCE_BIT)
    counts[_SOURCE_BIT] += max(0, quiet)
    counts[0] += max(0, total * len(TERMS) - sum(counts.values()))
    trust = accuracies(counts, _false_rates(kept, labels, len(TERMS)) if labels is not None else None)
    best = F.element_at(F.array(*[F.lit(p) for p in trust]), F.col("pattern") + 1)
    found = kept.where("subject is not null and doc_id is not null").join(F.broadcast(known), "subject", "left_semi")
    return found.groupBy("doc_id", "subject").agg(F.round(F.max(best), 6).alias("posterior")).where(F.col("posterior") >= threshold)
