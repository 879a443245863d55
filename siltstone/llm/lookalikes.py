"""Visually identical text to one consistent form.

Each text is normalised for compatibility (widths, kinds of blank, joined letter forms, composition of
accents) and ignorable characters are deleted. Then every token spans a lattice: each of its characters,
as it stands, may be read as any letter of its shape in any script the corpus is written in, and a letter
without case as either case. Viterbi search under character bigram scores, which favour readings in one
script, decides how the token is read. Which letters share a shape comes from the Unicode table of
confusable characters (UTS #39), in the copy that Spark's own ICU library holds.

Letters of one shape have the same readings, so tokens that look the same get the same path. A letter
without case, as the upright stroke that may be an l or an I, takes the case that its neighbours speak for.

Raised, lowered and circled forms, letter styles such as bold, case, accents and punctuation stay as
they are: they show. Null stays null, empty stays empty.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters without shape or width besides those of category Cf.
EXTRA_IGNORABLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
JOINED = ("<initial>", "<medial>", "<final>", "<isolated>")
SAME_WIDTHLESS = ("<wide>", "<narrow>", "<noBreak>")
SWITCH_PENALTY = 8.0
FLOOR = math.log(1e-6)
END = "\x00"  # no text holds it once it is plain
_MARK = r"\u0300-\u036f"
_ASCII_OR_END = re.compile(f"{END}|[A-Za-z]+")
_MARKS = re.compile(f"[{_MARK}]+")
_CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")
_CACHE_MOST = 500_000
#: Texts are joined for tokenising up to so many characters, whatever the rows of a batch hold.
_SLICE = 4_000_000


@lru_cache(maxsize=2)
def letter_pattern(all_planes: bool) -> re.Pattern:
    """Runs of letters with their accents, or END. The class of the first plane is a bitmap to the regex engine, that of all is slower."""
    known = [n for n in range(0x110000 if all_planes else 0x10000) if unicodedata.category(chr(n))[0] == "L"]
    cuts = [i for i, (a, b) in enumerate(zip([-2, *known], known)) if b != a + 1]
    letters = "".join(f"\\U{known[lo]:08x}-\\U{known[hi - 1]:08x}" for lo, hi in zip(cuts, [*cuts[1:], len(known)]))
    return re.compile(rf"[{letters}][{letters}{_MARK}]*|{END}")


def pattern_for(text: str) -> re.Pattern:
    if text.isascii():
        return _ASCII_OR_END
    # Two bytes a character in UTF-16, unless some character lies beyond the first plane.
    return letter_pattern(len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text))


@lru_cache(maxsize=None)
def compatible(ch: str) -> str:
    """What one character becomes, by rule from its Unicode properties; itself if nothing applies."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or ord(ch) in EXTRA_IGNORABLE or (kind == "Cc" and ch not in "\t\n\v\f\r\x1c\x1d\x1e\x85"):
        return ""
    if kind == "Zs" or ch in "\t\v\f":
        return " "
    if kind in ("Zl", "Zp") or ch in "\r\x1c\x1d\x1e\x85":
        return "\n"
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in SAME_WIDTHLESS or tag in JOINED:
        return unicodedata.normalize("NFKC", ch)
    if tag == "<compat>" and kind[0] == "L" and " " in rest and all(unicodedata.category(chr(int(x, 16)))[0] == "L" for x in rest.split()):
        return unicodedata.normalize("NFKC", ch)
    return ch


_KEPT: set[str] = set()  # characters known to stay


def plain(text: str) -> str:
    """Compatibility forms with accents composed; characters are replaced by distinct character, not one by one."""
    if text.isascii() and not _CONTROL.search(text):
        return text
    text = text.replace("\r\n", "\n")
    for ch in sorted(set(text) - _KEPT):
        new = compatible(ch)
        if new == ch:
            _KEPT.add(ch)
        else:
            text = text.replace(ch, new)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


@lru_cache(maxsize=200_000)
def script(ch: str) -> str:
    """The script of a letter, by the first word of its Unicode name; '' for what is no letter."""
    return unicodedata.name(ch, "").partition(" ")[0] if unicodedata.category(ch)[0] == "L" else ""


def shape_classes(spark: SparkSession) -> list[tuple[str, ...]]:
    """Letters that share a shape and a case, from the table of confusable characters in Spark's ICU library.

    Taken are all letters that decompose into nothing else. A letter without case belongs to the classes
    of either case of its shape. Classes of a single letter are left out. The table is the same for all
    data; it holds some thousand letters.
    """
    letters = [ch for ch in map(chr, range(0x41, 0x30000)) if unicodedata.category(ch) in ("Lu", "Lt", "Ll", "Lo") and not unicodedata.decomposition(ch)]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    if len(skeletons) != len(letters):
        raise RuntimeError("the table of confusable characters has changed its form")
    cased: dict[tuple[str, bool], list[str]] = defaultdict(list)
    free: dict[str, list[str]] = defaultdict(list)
    for ch, shape in zip(letters, skeletons):
        kind = unicodedata.category(ch)
        if not shape:
            continue
        if kind == "Lo":
            free[shape].append(ch)
        else:
            cased[shape, kind != "Ll"].append(ch)
    out = [tuple(sorted(own + free.get(shape, []))) for (shape, _), own in cased.items()]
    out += [tuple(sorted(own)) for shape, own in free.items() if (shape, True) not in cased and (shape, False) not in cased]
    return sorted(c for c in out if len(c) > 1)


class Shapes:
    """Lookups over shape classes: the classes of a letter, and the symbol under which it is counted."""

    def __init__(self, classes: list[tuple[str, ...]]):
        self.classes = classes
        self.of: dict[str, tuple[int, ...]] = {}
        for i, members in enumerate(classes):
            for ch in members:
                self.of[ch] = (*self.of.get(ch, ()), i)

    def symbol(self, ch: str) -> str:
        """A letter of some class stands for itself, any other for its script and case: the symbols are bounded by the table."""
        return ch if ch in self.of else f"{script(ch)}:{unicodedata.category(ch)}"


def tokens_and_ends(texts: list[str]) -> list[str]:
    """The letter tokens of plain texts in order, END after each text."""
    joined = END.join([*texts, ""])
    return pattern_for(joined).findall(joined)


def slices(texts: list[str]) -> Iterator[list[int]]:
    """Indexes of the texts, those in ASCII by themselves, in groups of about _SLICE characters at most."""
    for ascii_ in (True, False):
        group, size = [], 0
        for i, t in enumerate(texts):
            if t.isascii() == ascii_:
                group.append(i)
                size += len(t)
                if size >= _SLICE:
                    yield group
                    group, size = [], 0
        if group:
            yield group


def bigram_counts(documents: DataFrame, text: str, shapes: Shapes) -> DataFrame:
    """Counts (a, b, n) of neighbouring symbols in tokens written in one script, over all rows.

    '' stands for the start and the end of a token. Counts are combined in each task first; the result is
    bounded by the square of the symbols, whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()

        def fold() -> None:
            words.pop(END, None)
            for word, n in words.items():
                letters = _MARKS.sub("", unicodedata.normalize("NFD", word))
                found = {script(c) for c in letters}
                if len(found) == 1 and "" not in found:
                    symbols = [shapes.symbol(c) for c in letters]
                    for a, b in zip(["", *symbols], [*symbols, ""]):
                        pairs[a, b] += n
            words.clear()

        for batch in batches:
            texts = [plain(t) for t in batch.column(0).to_pylist() if t]
            for group in slices(texts):
                words.update(tokens_and_ends([texts[i] for i in group]))
            if len(words) > _CACHE_MOST:
                fold()
        fold()
        keys = list(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([pairs[k] for k in keys], pa.int64())], ["a", "b", "n"]
        )

    return documents.select(text).mapInArrow(count, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Model:
    """Log scores of symbol bigrams within a script, add-one-half smoothed, and the readings of every letter.

    Of the letters of a shape, the most frequent one of each script is a reading (the first by code point
    among equals); scripts that no token is written in are none. Where no script of the corpus has the
    shape, the class's first letter stands for all.
    """

    def __init__(self, counts: dict[tuple[str, str], int], shapes: Shapes):
        self.shapes = shapes
        seen: Counter[str] = Counter()
        for (_, b), n in counts.items():
            seen[b] += n
        known = {self.script_of(s) for s in seen if s}
        self.readings: list[tuple[str, ...]] = []
        for members in shapes.classes:
            best: dict[str, str] = {}
            for ch in members:
                s = script(ch)
                if s in known and (s not in best or seen[ch] > seen[best[s]]):
                    best[s] = ch
            self.readings.append(tuple(best[s] for s in sorted(best)) or (members[0],))
        symbols = sorted({s for s in seen if s} | {c for r in self.readings for c in r})
        self.at = {s: i + 1 for i, s in enumerate(symbols)}  # 0: the start and the end
        size = len(symbols) + 1
        table = np.zeros((size, size))
        for (a, b), n in counts.items():
            table[self.at.get(a, 0), self.at.get(b, 0)] += n
        names = sorted({self.script_of(s) for s in symbols})
        self.of = np.array([-1, *(names.index(self.script_of(s)) for s in symbols)])
        self.score = np.full((size, size), FLOOR)
        for s in range(len(names)):
            own = np.flatnonzero(self.of == s)
            # A start in this script competes with starts in the others, so rare scripts stay rare.
            into, all_in = table[np.ix_([0, *own], own)], table[np.ix_(own, [*own, 0])].sum(axis=1)
            total = np.array([table[0].sum(), *all_in])[:, None]
            self.score[np.ix_([0, *own], own)] = np.log((into + 0.5) / (total + 0.5 * (len(own) + 1)))
            self.score[own, 0] = np.log((table[own, 0] + 0.5) / (all_in + 0.5 * (len(own) + 1)))
        apart = (self.of[:, None] != self.of[None, :]) & (self.of[:, None] >= 0) & (self.of[None, :] >= 0)
        self.score[apart] -= SWITCH_PENALTY

    @staticmethod
    def script_of(symbol: str) -> str:
        return symbol.partition(":")[0] if len(symbol) > 1 else script(symbol)

    def lattice(self, token: str) -> list[tuple[str, ...]]:
        """The readings of each letter of a token without accents."""
        of, readings = self.shapes.of, self.readings
        return [tuple(dict.fromkeys(c for k in of[ch] for c in readings[k])) if ch in of else (ch,) for ch in token]

    def best(self, tokens: list[str]) -> list[str]:
        """The best path of each token's lattice, with the token's accents, composed."""
        apart = [unicodedata.normalize("NFD", t) for t in tokens]
        lattices = [self.lattice(_MARKS.sub("", t)) for t in apart]
        picks: list[list[str]] = [[] for _ in tokens]
        # A token with one reading needs no search; the others are searched by length, many at a time.
        by_length: dict[int, list[int]] = {}
        for i, rows in enumerate(lattices):
            if all(len(r) == 1 for r in rows):
                picks[i] = [r[0] for r in rows]
            else:
                by_length.setdefault(len(rows), []).append(i)
        for group in by_length.values():
            for lo in range(0, len(group), 4096):
                some = group[lo : lo + 4096]
                for i, path in zip(some, self.viterbi([lattices[i] for i in some])):
                    picks[i] = path
        out = []
        for t, path in zip(apart, picks):
            letters = iter(path)
            out.append(unicodedata.normalize("NFC", "".join(c if "\u0300" <= c <= "\u036f" else next(letters) for c in t)))
        return out

    def viterbi(self, lattices: list[list[tuple[str, ...]]]) -> list[list[str]]:
        """The best paths of lattices of one length; of equal paths the first."""
        n, length, wide = len(lattices), len(lattices[0]), max(len(r) for rows in lattices for r in rows)
        index = np.zeros((n, length, wide), dtype=np.int32)
        open_ = np.zeros((n, length, wide), dtype=bool)
        at, symbol = self.at, self.shapes.symbol
        for i, rows in enumerate(lattices):
            for k, row in enumerate(rows):
                for j, ch in enumerate(row):
                    index[i, k, j], open_[i, k, j] = at.get(symbol(ch), 0), True
        total = np.where(open_[:, 0], self.score[0, index[:, 0]], -np.inf)
        back = np.zeros((n, length, wide), dtype=np.int16)
        for k in range(1, length):
            paths = total[:, :, None] + self.score[index[:, k - 1, :, None], index[:, k, None, :]]
            back[:, k] = paths.argmax(axis=1)
            total = np.where(open_[:, k], paths.max(axis=1), -np.inf)
        total = total + self.score[index[:, length - 1], 0]
        state = total.argmax(axis=1)
        states = np.zeros((n, length), dtype=np.int16)
        for k in range(length - 1, -1, -1):
            states[:, k] = state
            state = back[np.arange(n), k, state]
        return [[row[states[i, k]] for k, row in enumerate(rows)] for i, rows in enumerate(lattices)]


class Canonicaliser:
    """Texts to their consistent form; remembers the tokens it has resolved."""

    def __init__(self, model: Model):
        self.model, self.known, self.changes = model, set(), {}

    def _resolve(self, words: set[str]) -> None:
        if len(self.known) > _CACHE_MOST:
            self.known.clear()
            self.changes.clear()
        new = sorted(words - self.known)
        self.known.update(new)
        self.changes.update((w, f) for w, f in zip(new, self.model.best(new)) if w != f)

    def __call__(self, texts: list[str | None]) -> list[str | None]:
        places = [i for i, t in enumerate(texts) if t is not None]
        plains = [plain(texts[i]) for i in places]
        for group in slices(plains):
            tokens = tokens_and_ends([plains[i] for i in group])
            distinct = set(tokens)
            distinct.discard(END)
            self._resolve(distinct)
            changed = distinct & self.changes.keys()
            if not changed:
                continue
            touched, doc = set(), 0
            for w in tokens:
                if w == END:
                    doc += 1
                elif w in changed:
                    touched.add(doc)
            change = self.changes
            for k in touched:
                text = plains[group[k]]
                plains[group[k]] = pattern_for(text).sub(lambda m: change.get(m.group(), m.group()), text)
        out = list(texts)
        for i, t in zip(places, plains):
            out[i] = t
        return out


def train(documents: DataFrame, text: str, shapes: Shapes | None = None) -> Model:
    """The bigram model of all rows; what comes to the driver is bounded by the square of the symbols."""
    shapes = shapes or Shapes(shape_classes(documents.sparkSession))
    return Model({(r["a"], r["b"]): r["n"] for r in bigram_counts(documents, text, shapes).collect()}, shapes)


def consistent_form(text: Column, model: Model) -> Column:
    """The consistent form of whole texts under a model. Only forms that differ from their text leave Python."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to = Canonicaliser(model)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            yield pd.Series([None if f == t else f for t, f in zip(texts, to(texts))], dtype=object)

    return F.coalesce(form(text), text)


def look_alike_classes(forms: DataFrame, id_col: str, text_key: str, form_key: str) -> tuple[DataFrame, DataFrame]:
    """(classes, texts) of rows of equal form_key: what holds the pairs without expanding them.

    classes: form_key, class_id (the least id), n_rows, n_texts. texts: form_key, text_key, text_id (the
    least id with that text), n_rows. Rows with a null key take no part. Both are combined map-side, so a
    form or text with very many rows is no burden.
    """
    rows = forms.select(F.col(id_col).alias("id"), text_key, form_key).where(F.col(text_key).isNotNull() & F.col(form_key).isNotNull())
    texts = rows.groupBy(form_key, text_key).agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("n_rows"))
    classes = texts.groupBy(form_key).agg(F.min("text_id").alias("class_id"), F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))
    return classes, texts


def look_alike_members(forms: DataFrame, id_col: str, text_key: str, form_key: str) -> DataFrame:
    """One row per row with both keys: id, class_id and n_links, the rows of equal form and another text."""
    classes, texts = look_alike_classes(forms, id_col, text_key, form_key)
    sizes = texts.select(form_key, text_key, F.col("n_rows").alias("_own")).join(classes.select(form_key, "class_id", "n_rows"), form_key)
    return forms.select(F.col(id_col).alias("id"), text_key, form_key).join(sizes, [form_key, text_key]).select("id", "class_id", (F.col("n_rows") - F.col("_own")).alias("n_links"))


def look_alike_pairs(forms: DataFrame, id_col: str, text_key: str, form_key: str, block: int = 1024) -> DataFrame:
    """Every pair (doc_a < doc_b) of equal form_key and different text_key: the classes written out.

    Pairs are formed between the distinct texts of a form and then expanded by the rows of each text;
    byte-identical copies are never compared with each other. The texts of a form that has very many are
    split into blocks, and pairs of blocks are joined, so no task forms all pairs of one form. Rows of one
    id make no pair with each other; a row that is there twice makes its pairs twice.
    """
    rows = forms.select(F.col(id_col).alias("id"), F.col(text_key).alias("t"), F.col(form_key).alias("f")).where("t is not null and f is not null")
    classes, texts = look_alike_classes(rows, "id", "t", "f")
    several = classes.where("n_texts > 1").select("f", F.ceil(F.col("n_texts") / F.lit(block)).alias("n"))
    texts = texts.select("f", "t").join(several, "f").withColumns({"own": F.pmod(F.xxhash64("t"), F.col("n")), "other": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))})
    a = texts.select("f", F.col("own").alias("i"), F.col("other").alias("j"), F.col("t").alias("ta"))
    b = texts.select("f", F.col("other").alias("i"), F.col("own").alias("j"), F.col("t").alias("tb"))
    pairs = a.join(b, ["f", "i", "j"]).where("ta < tb").select("ta", "tb")
    left = pairs.join(rows.select(F.col("t").alias("ta"), F.col("id").alias("ia")), "ta")
    both = left.join(rows.select(F.col("t").alias("tb"), F.col("id").alias("ib")), "tb")
    return both.where("ia <> ib").select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b"))
