"""Text decoded with the wrong character encoding, found and restored through the garbled forms of clean words.

Every distinct word of the corpus that itself looks sound is garbled under all chains of a wrong encoding (written
in one, read in another, once or twice over, with undefined bytes kept or replaced). Documents' words are
hash-joined against this table; a hit is accepted if the form is unnatural or far rarer than its original. Words are
compared at these grains, each garbled the same way:

- whole words, without ASCII punctuation at the ends, and with or without the other signs at their ends, which may be
  quotation marks or part of what is garbled,
- the runs of non-ASCII characters in them, as ``’s`` in a name's genitive that occurs only once,
- for scripts written without spaces, runs of three characters, whose forms are compared by shingles of three, in the
  whole run and in each stretch of other scripts that it holds; and, for single garbled words within clean text, pairs
  of characters, whose whole forms are looked up; a form of two characters tells too little and needs both neighbours, or
  a third garbled character.

Where garbled and clean spelling are about as frequent, a document's words tell together: it is garbled if its letters fit
no language's alphabet, but do with the words that one chain explains put right (or if that puts several words in capitals
into small letters). What is explained so does not count as use of a word. A form is far rarer if it is
so in rows or in distinct texts, as either may be copies. No word of a language happens to be what the UTF-8 of another
word of the corpus reads as byte by byte, so such a form of two characters or more needs no further evidence.

Each distinct word is judged once; only words with a hit are joined back to the documents. What a text cites is no word
of it: non-ASCII signs between quotation marks that stand for one single character, as they are or once a chain is
undone, or that are the garbled form of something else that the text puts between quotation marks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.lineage import cut

#: Encodings as Python names them. ``web-1252`` is cp1252 with its undefined bytes kept, as browsers read it.
SINGLE = (
    "web-1252", "latin-1", "cp1250", "cp1251", "cp1252", "cp437", "cp850", "cp852", "cp866", "koi8-r",
    "iso8859-2", "iso8859-5", "iso8859-15", "mac-roman", "mac-latin2", "mac-cyrillic",
)
MULTI = ("cp932", "gb18030", "big5", "euc-jp", "euc-kr")
#: Readings that are met twice over.
TWICE = ("web-1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman")

_RUN = re.compile(r"[^\x00-\x7f]+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿｡-ﾟ]")
#: Characters that stand for nothing: replaced, control, private or unassigned ones.
_LOST = regex.compile(r"[\ufffd\x80-\x9f\p{Co}\p{Cn}]")
#: What words are written with: a decoding to anything else makes no sense.
_USUAL = regex.compile(r"[\x20-\x7e\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}]*")
#: Punctuation and spaces other than ASCII ones at the ends of a word or run.
_SIGNS = regex.compile(r"(?V1)[[\p{P}\p{Z}]--[\x00-\x7f]]*")
_SIGNS_END = regex.compile(r"(?r)(?V1)[[\p{P}\p{Z}]--[\x00-\x7f]]*$")
_WHOLE = re.compile(r".+", re.DOTALL)
#: A stretch without characters of scripts that have no spaces, in which it may be embedded.
_SEGMENT = re.compile(r"[^\u3001-\u30ff\u3400-\u9fff]+")
#: Two characters of such a script.
_PAIR = re.compile(r"[\u3005-\u3007\u3041-\u30ff\u3400-\u9fff]{2}")
#: Alphabets that no word mixes, and the scripts that Latin letters stand next to in one word only where there are kana.
_ALPHABETIC = [regex.compile(rf"\p{{Script={name}}}") for name in ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Thai", "Georgian")]
_HAN = regex.compile(r"\p{Script=Han}")
_KANA = regex.compile(r"[\p{Script=Hiragana}\p{Script=Katakana}]")


#: How cp1252 differs from Latin-1, which keeps the five bytes that it leaves undefined; and back.
_WEB = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_WEB_BACK = {ord(c): chr(b) for b, c in _WEB.items()}


def _encode(text: str, encoding: str) -> bytes | None:
    try:
        return text.translate(_WEB_BACK).encode("latin-1") if encoding == "web-1252" else text.encode(encoding)
    except UnicodeError:
        return None


def _decode(data: bytes, encoding: str) -> str:
    return data.decode("latin-1").translate(_WEB) if encoding == "web-1252" else data.decode(encoding, "replace")


def _sequences() -> str:
    """A pattern of whole UTF-8 sequences as single-byte encodings read them, with a sign among the bytes that continue one."""
    found = set()
    for read in SINGLE:
        kinds = []
        for first, last in ((0xC2, 0xDF), (0xE0, 0xEF), (0x80, 0xBF)):
            kinds.append([_decode(bytes([b]), read) for b in range(first, last + 1)])
        two, three, more = ("[" + "".join(regex.escape(c) for c in dict.fromkeys(kind) if c != "\ufffd") + "]" for kind in kinds)
        sign = f"(?=[^\\p{{L}}]){more}"
        found.add(f"{two}{sign}|{three}(?:{sign}{more}|{more}{sign})")
    return "|".join(sorted(found))


#: A sign that is no usual punctuation between letters, a capital within a word, or arrows, frames and the like next to non-ASCII characters.
_ODD = regex.compile(
    r"(?V1)\p{L}[[\p{S}\p{No}\xad‚„‹›†‡•…‰¡¿]--[\x00-\x7f°]]\p{L}"
    r"|\p{Ll}(?=[^\x00-\x7f])\p{Lu}"
    r"|[\u2190-\u25ff][^\x00-\x7f\u2190-\u25ff\s]|[^\x00-\x7f\u2190-\u25ff\s][\u2190-\u25ff]"
    r"|" + _sequences()
)


@lru_cache(1 << 16)
def unnatural(word: str) -> bool:
    """Whether no language writes a word like this: lost or control characters, signs inside it, mixed scripts or case."""
    if _LOST.search(word) or _ODD.search(word):
        return True
    scripts = sum(bool(p.search(word)) for p in _ALPHABETIC)
    return scripts > 1 or bool(_ALPHABETIC[0].search(word) and _HAN.search(word) and not _KANA.search(word))


def bare(text: str) -> list[str]:
    """A text with its signs at the ends, without all at one or both ends, and without each number of them at one end.

    As many as it has signs, so a long row of them costs no more than itself.
    """
    a, b = len(_SIGNS.match(text).group()), len(_SIGNS_END.search(text).group())
    n = len(text)
    if a == n:
        return [text]
    cuts = {(i, j) for i in range(a + 1) for j in (0, b)} | {(i, j) for j in range(b + 1) for i in (0, a)}
    return list(dict.fromkeys(text[i : n - j] for i, j in sorted(cuts)))


#: The letters besides a to z of languages, small.
_ALPHABETS = (
    "àâæçéèêëîïôœùûüÿ", "äöüßé", "áéíóúüñºª", "áâãàçéêíóôõúüºª", "àèéìíîòóùú", "ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž",
    "áéíóöőúüű", "ăâîșțşţ", "čćđšž", "çğıöşüâîû", "åäöæøé", "áéèêëïíóôöúü", "àçèéíïòóúü", "ąčęėįšųūž", "āčēģīķļņšūž", "äõöüšž",
    "áðéíóúýþæö", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "абвгдеёжзійклмнопрстуўфхцчшыьэюя",
    "абвгдђежзијклљмнњопрстћуфхцчџш",
)
_ANY = (1 << len(_ALPHABETS)) - 1
_LETTERS: dict[str, int] = defaultdict(int)
for _bit, _letters in enumerate(_ALPHABETS):
    for _c in _letters:
        _LETTERS[_c] |= 1 << _bit
#: Letters that may belong to an alphabet here; those of other scripts tell nothing.
_JUDGED = re.compile(r"[ªºÀ-ÖØ-öø-ɏЀ-џҐґ]")


def languages(word: str) -> int:
    """A bit for each alphabet that has all letters of a word."""
    bits = _ANY
    for c in set(_JUDGED.findall(word.lower())):
        bits &= _LETTERS.get(c, 0)
    return bits


def chains(text: str) -> Iterator[tuple[str, str]]:
    """Chains and the garbled forms of a text under them; a form may come under several chains."""
    utf8 = text.encode("utf-8")
    for read in (*SINGLE, *MULTI):
        yield f"utf-8>{read}", _decode(utf8, read)
    for once in TWICE:
        data = _decode(utf8, once).encode("utf-8")
        for twice in TWICE:
            yield f"utf-8>{once}>utf-8>{twice}", _decode(data, twice)
    for written in (*SINGLE, *MULTI):
        if written == "web-1252":
            continue
        data = _encode(text, written)
        if data is not None:
            for read in ("utf-8", *SINGLE, *MULTI):
                if read != written:
                    yield f"{written}>{read}", _decode(data, read)


def undo(text: str, chain: str) -> str | None:
    """The text that the chain turned into ``text``, if it does so without loss."""
    steps = chain.split(">")
    plain: str | None = text
    for written, read in reversed(list(zip(steps[::2], steps[1::2]))):
        data = _encode(plain, read)
        try:
            plain = None if data is None else data.decode(written)
        except UnicodeError:
            return None
        if plain is None:
            return None
    return plain


@lru_cache(1 << 16)
def looks_garbled(word: str) -> bool:
    """Whether a word is no clean original: characters are lost, or its bytes in some single-byte encoding are UTF-8 that makes sense."""
    if _LOST.search(word):
        return True
    for form in bare(word):
        for read in ("web-1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac-roman"):
            data = None if form.isascii() else _encode(form, read)
            if data is not None:
                try:
                    plain = data.decode("utf-8")
                except UnicodeError:
                    continue
                if _USUAL.fullmatch(plain) and not unnatural(plain):
                    return True
    return False


def _sources(word: str) -> Iterator[tuple[str, str]]:
    """Grain and text of what a word gives to be garbled: word, run, run with the next ASCII character, run of three."""
    spaced = not _UNSPACED.search(word)
    whole = word.strip(_EDGE)
    if spaced and whole:
        yield "word", whole
        yield "word", bare(whole)[-1]
    for m in _RUN.finditer(word):
        run = m.group()
        # Longer runs without spaces are told by their shingles.
        if spaced or len(run) <= 3:
            yield "run", run
        if spaced and m.end() < len(word):
            yield "run", run + word[m.end()]
        if not spaced:
            for i in range(max(1, len(run) - 2)):
                yield "three", run[i : i + 3]
            for window in _windows(run):
                if _PAIR.fullmatch(window[1:3]):
                    yield "pair", window[1:3]
                    yield "bounded", window


def _windows(run: str) -> list[str]:
    """Every two neighbouring characters of a run with those before and after; line feeds stand for its ends."""
    padded = f"\n{run}\n"
    return [padded[i : i + 4] for i in range(len(run) - 1)]


def _shingles(run: str) -> set[str]:
    return {run[i : i + 3] for i in range(len(run) - 2)}


def _forms(grain: str, text: str) -> dict[tuple[str, str], str]:
    """(grain, form) of a source's garbled forms, with a chain for each."""
    forms: dict[tuple[str, str], str] = {}
    if grain == "bounded":
        # Longer forms are looked up without neighbours; only encodings of two bytes a character give ones of two.
        for written in MULTI:
            data = _encode(text[1:3], written)
            for read in MULTI if data is not None else ():
                form = _decode(data, read)
                if len(form) == 2 and form != text[1:3]:
                    forms.setdefault((grain, text[0] + form + text[3]), f"{written}>{read}")
        return forms
    distinct: dict[str, str] = {}
    for chain, garbled in chains(text):
        distinct.setdefault(garbled, chain)
    distinct.pop(text, None)
    for garbled, chain in distinct.items():
        if grain == "word":
            for form in {garbled.strip(_EDGE), garbled.rstrip("\xa0\x85").strip(_EDGE)}:
                if form != text and not form.isascii():
                    forms.setdefault(("word", form), chain)
        elif grain == "run":
            for form in _RUN.findall(garbled):
                if form not in text:
                    forms.setdefault(("run", form), chain)
                    forms.setdefault(("run", form.rstrip("\xa0\x85")), chain)
        elif grain == "pair":
            # The end of a pair may take in what follows it.
            for form in (garbled, garbled.rstrip("�")):
                if len(form) >= 2 and not form.isascii():
                    forms.setdefault(("pair", form), chain)
        else:
            if len(text) == len(garbled) == 3 and not garbled.isascii():
                forms.setdefault(("pair", garbled), chain)
            for run in _RUN.findall(garbled):
                for form in _shingles(run):
                    forms.setdefault(("three", form), chain)
    if grain == "run" and text[-1].isascii():
        # Only what takes the ASCII character in; the rest belongs to the run itself.
        own = _forms(grain, text[:-1])
        return {k: c for k, c in forms.items() if k[1] and k not in own}
    return {k: c for k, c in forms.items() if k[1]}


def _table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The garbled forms of sources (``grain, text, df, texts``)."""
    for batch in batches:
        for start in range(0, len(batch), 500):
            out = []
            for grain, text, df, texts in batch.iloc[start : start + 500].itertuples(index=False):
                if not looks_garbled(text):
                    out.extend((g, form, text, chain, df, texts) for (g, form), chain in _forms(grain, text).items())
            yield pd.DataFrame(out, columns=["grain", "form", "original", "chain", "df", "texts"])


#: Rows that a batch is given out at.
_ROWS = 20_000


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What of each word (``id, word, df, texts``) is looked up: itself, its runs, the shingles of its longer runs, and what may be a pair's form."""
    columns = ["id", "grain", "form", "run", "parts", "df", "texts", "odd"]
    for batch in batches:
        out: list[tuple] = []
        for at, word, df, texts in batch.itertuples(index=False):
            counted: set[tuple[str, str]] = set()
            for grain, form, run, parts, odd in _of_word(word):
                # What a word holds several times counts once.
                again = (grain, form) in counted
                out.append((at, grain, form, run, parts, 0 if again else df, 0 if again else texts, odd))
                counted.add((grain, form))
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


def _of_word(word: str) -> Iterator[tuple[str, str, int, int, bool]]:
    whole = word.strip(_EDGE)
    for form in bare(whole) if whole and not whole.isascii() else ():
        if form and not form.isascii():
            yield "word", form, 0, 0, unnatural(form)
    for k, m in enumerate(_RUN.finditer(word)):
        run = m.group()
        # A run is judged with its neighbours.
        odd = unnatural(word[max(0, m.start() - 1) : m.end() + 1])
        for form in bare(run):
            yield "run", form, k, 0, odd
        if len(run) >= 4:
            parts = _shingles(run)
            for part in parts:
                yield "three", part, k, len(parts), unnatural(part)
    if _UNSPACED.search(word):
        for grain, form, k, n in set(_inner(word)):
            yield grain, form, k, n, unnatural(form)


def _inner(word: str) -> Iterator[tuple[str, str, int, int]]:
    """Grain, form, run and parts of what a word without spaces may hold of garbled text within clean text."""
    for k, m in enumerate(_SEGMENT.finditer(word)):
        # A stretch of other scripts is judged by its own shingles; runs have numbers from 0 on.
        segment = m.group()
        if len(segment) < len(word) and not segment.isascii():
            if 2 <= len(segment) <= 24:
                yield "pair", segment, 0, 0
            parts = {part for run in _RUN.findall(segment) for part in _shingles(run)}
            for part in parts:
                yield "three", part, -1 - k, len(parts)
    for m in _RUN.finditer(word):
        run = m.group()
        for i in range(len(run) - 1):
            for size in range(2, min(5, len(run) - i) + 1):
                form = run[i : i + size]
                if size > 2 or unnatural(form):
                    yield "pair", form, 0, 0
        for window in _windows(run):
            yield "bounded", window, 0, 0


def _emit_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["grain", "text", "df", "texts"]
    for batch in batches:
        out: list[tuple[str, str, int, int]] = []
        for word, df, texts in batch.itertuples(index=False):
            out.extend((grain, text, df, texts) for grain, text in set(_sources(word)))
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The languages of each word (``id, word``) and, if it is a form, of its original (``form, original, chain``)."""
    for batch in batches:
        out = []
        for at, word, form, original, chain in batch.itertuples(index=False):
            known = original is not None and not unnatural(original) and not looks_garbled(original)
            # Signs alone tell nothing of a language.
            known = known and bool(_JUDGED.search(form + original))
            small = known and len(form) >= 3 and form.isupper() and original.islower()
            out.append((at, languages(word), languages(original) if known else 0, bool(small), chain if known else None))
        yield pd.DataFrame(out, columns=["id", "bits", "right", "small", "chain"])


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words (``id``) of each document (``doc_id, text_hash, words``) that are garbled judged together."""
    for batch in batches:
        out = []
        for doc_id, text_hash, words in batch.itertuples(index=False):
            whole, best = _ANY, []
            for w in words:
                whole &= w["bits"]
            for chain in sorted({w["chain"] for w in words if w["chain"] is not None}):
                own = [w["id"] for w in words if w["chain"] == chain]
                right = _ANY
                for w in words:
                    right &= w["right"] if w["chain"] == chain else w["bits"]
                small = [w["id"] for w in words if w["chain"] == chain and w["small"]]
                found = own if whole == 0 and right != 0 and len(own) >= 2 else small if len(small) >= 3 else []
                best = max(best, found, key=len)
            out.extend((doc_id, text_hash, at) for at in best)
        yield pd.DataFrame(out, columns=["doc_id", "text_hash", "id"])


#: Non-ASCII characters alone between quotation marks.
_QUOTED = r"""(?<![^\s(\[>])["'“„«‹‘‚]\s?([^\x00-\x7f]+?)\s?["'”“»›’‘](?![^\s.,;:!?)\]<])"""


def cited(inner: str, others: set[str]) -> bool:
    """Whether a text that puts ``inner`` and ``others`` between quotation marks cites it as a sign, rather than uses it as a word."""
    if len(inner) == 1:
        return True
    once = (f"{written}>{read}" for written in ("utf-8", *MULTI) for read in (*SINGLE, *MULTI) if written != read)
    twice = (f"utf-8>{a}>utf-8>{b}" for a in TWICE for b in TWICE)
    if any(len(undo(inner, chain) or "") == 1 for chain in (*once, *twice)):
        return True
    return any(form == inner for other in others if other != inner for _, form in chains(other)) or any(
        form in others for _, form in chains(inner) if form != inner
    )


def without_citations(text: str) -> str:
    """The text with what it cites left out."""
    quoted = {m.group(1) for m in re.finditer(_QUOTED, text)}
    known = {inner for inner in quoted if cited(inner, quoted)}
    return re.sub(_QUOTED, lambda m: " " if m.group(1) in known else m.group(), text)


def _uncited(text: Column) -> Column:
    def edit(texts: pd.Series) -> pd.Series:
        return texts.map(without_citations, na_action="ignore")

    return F.pandas_udf(edit, "string")(text)


#: What parts words: ASCII whitespace and HTML tags.
_BREAK = r"(?:[ \t\n\x0B\f\r]|</?[A-Za-z]{1,10} ?/?>)+"


class GarbledText:
    """Garbled words of the documents, and the documents that hold them.

    A word is a run without ASCII whitespace and HTML tags. Null ids and texts are left out, empty texts hold nothing; a document
    whose row is repeated counts once. Empty tables give empty results. ``rarer`` is in how many times fewer rows or distinct texts than
    its original a garbled form must be that looks like a word of some language, apart from documents whose words tell together. ``share`` is the part of a long run's
    shingles that must be garbled forms, or ``stretch`` of them. Up to ``few`` documents to restore are broadcast. Whole texts of all documents are read; the words that are not ASCII are checkpointed.
    """

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarer: int = 4, share: float = 0.6, stretch: int = 6, few: int = 20_000) -> None:
        self.texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
        # Most texts have no such quotation and do not go to Python.
        quotes = F.col("text").rlike(_QUOTED)
        plain = F.when(quotes, _uncited(F.when(quotes, F.col("text")))).otherwise(F.col("text"))
        words = F.array_distinct(F.filter(F.split(plain, _BREAK), lambda w: w.rlike(r"[^\x00-\x7f]")))
        # Used three times, and splitting texts takes long.
        self.words = cut(
            self.texts.filter(F.col("text").rlike(r"[^\x00-\x7f]")).select(
                "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(words).alias("word")
            )
        )
        self.rarer, self.share, self.stretch, self.few = rarer, share, stretch, few
        numbered = self.words.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.count_distinct("text_hash").alias("texts"))
        numbered = numbered.withColumn("id", F.monotonically_increasing_id())
        self.distinct = cut(numbered)
        # Garbling and looking up take long for few bytes, so the number of tasks follows the words, not the bytes.
        self.tasks = max(documents.sparkSession.sparkContext.defaultParallelism, self.distinct.count() // 2000)

    def table(self) -> DataFrame:
        """``grain, form, df, texts, original, chain, ambiguous`` of every garbled form: its most frequent original."""
        sources = self.distinct.select("word", "df", "texts").mapInPandas(_emit_sources, "grain string, text string, df long, texts long")
        # The byte order mark, which any text may begin with and none shows when read rightly.
        sums = F.sum("df").alias("df"), F.sum("texts").alias("texts")
        mark = self.distinct.groupBy().agg(*sums).select(F.lit("run").alias("grain"), F.lit("\ufeff").alias("text"), "df", "texts")
        sources = sources.unionByName(mark.dropna()).groupBy("grain", "text").agg(*sums)
        forms = sources.repartition(self.tasks).mapInPandas(_table, "grain string, form string, original string, chain string, df long, texts long")
        best = F.max(F.struct("df", "original", "chain", "texts")).alias("best")
        return (
            forms.groupBy("grain", "form")
            .agg(best, F.sum("df").alias("total"))
            .select("grain", "form", "best.df", "best.texts", "best.original", "best.chain", (F.col("best.df") < 0.6 * F.col("total")).alias("ambiguous"))
        )

    @cached_property
    def looked_up(self) -> DataFrame:
        """The pieces that are garbled forms: ``id`` of the word, ``grain, form, run, parts, odd, own, own_texts, df, texts, original, chain, ambiguous``."""
        # Long words have many pieces, so these carry the word's number.
        pieces = self.distinct.select("id", "word", "df", "texts").repartition(self.tasks).mapInPandas(
            _pieces, "id long, grain string, form string, run int, parts int, df long, texts long, odd boolean"
        )
        # How frequent a piece is over all words that hold it.
        usual = pieces.groupBy("grain", "form").agg(F.sum("df").alias("own"), F.sum("texts").alias("own_texts"))
        known = usual.join(self.table(), ["grain", "form"])
        return cut(pieces.select("id", "grain", "form", "run", "parts", "odd").join(known, ["grain", "form"]))

    @cached_property
    def together(self) -> DataFrame:
        """``doc_id, text_hash, id`` of the words that are garbled as the document's words tell together."""
        forms = self.looked_up.filter("grain = 'word'").select("id", "form", "original", "chain")
        fit = (
            self.distinct.join(forms, "id", "left")
            .select("id", "word", "form", "original", "chain")
            .mapInPandas(_fit, "id long, bits long, right long, small boolean, chain string")
            .filter(F.col("chain").isNotNull() | (F.col("bits") != _ANY))
        )
        numbered = fit.join(self.distinct.select("id", "word"), "id")
        documents = self.words.join(numbered, "word").groupBy("doc_id", "text_hash")
        word = F.struct("id", "bits", "right", "small", "chain")
        candidates = (F.bit_and("bits") == 0) | (F.count_if("small") >= 3)
        judged = documents.agg(F.collect_list(word).alias("words"), candidates.alias("candidate")).filter("candidate")
        return cut(
            judged.filter(F.exists("words", lambda w: w["chain"].isNotNull()))
            .select("doc_id", "text_hash", "words")
            .mapInPandas(_together, "doc_id long, text_hash long, id long")
        )

    def hits(self) -> DataFrame:
        """The accepted look-ups: ``id`` of the word, ``grain, form, run, parts, original, chain, ambiguous``."""
        # Texts in which the use of a form is already explained are none that use it as a word.
        words = self.looked_up.filter("grain = 'word'").select("id", "form")
        explained = self.together.join(words, "id").groupBy("form").agg(
            F.count_distinct("doc_id").alias("explained"), F.count_distinct("text_hash").alias("explained_texts")
        )
        known = self.looked_up.join(explained.withColumn("grain", F.lit("word")), ["grain", "form"], "left")

        def rarer(times: int) -> Column:
            rows = F.col("own") - F.coalesce("explained", F.lit(0))
            texts = F.col("own_texts") - F.coalesce("explained_texts", F.lit(0))
            return (F.col("df") >= times * rows) | (F.col("texts") >= times * texts)

        size = F.length("form")
        # Short forms tell little, unless they hold symbols, are longer than their original or of another script.
        foreign = F.col("form").rlike(r"^\p{IsHan}$") & ~F.col("original").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
        two = (size == 2) & (F.col("form").rlike(r"[^\p{L}\p{M}\p{N}]") | (F.length("original") == 1))
        rare = rarer(self.rarer) & ((size >= 3) | two)
        rare = rare | (foreign & rarer(2 * self.rarer))
        read = F.regexp_extract("chain", "^utf-8>([^>]+)", 1)
        whole = F.col("grain").isin("word", "run") & read.isin(*SINGLE) & (F.length("original") >= 2) & (F.octet_length("original") >= 3)
        # A single letter can be a word of any language.
        alone = (F.col("grain") == "word") & (size == 1) & F.col("form").rlike(r"\p{L}") & ~foreign
        return known.filter(~alone).filter(F.col("odd") | rare | whole).drop("odd", "own", "own_texts", "df", "texts", "explained", "explained_texts")

    def garbled_words(self) -> DataFrame:
        """``word, wholes, runs, pairs, chains``: each garbled word, with what is known to restore it."""
        return self._put_together(self.hits())

    def _put_together(self, hits: DataFrame) -> DataFrame:
        shingled = (
            hits.groupBy("id", "grain", "run", F.when(F.col("grain") != "three", F.col("form")).alias("form"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.max("parts").alias("parts"),
                F.max("original").alias("original"),
                F.mode("chain").alias("chain"),
                F.max("ambiguous").alias("ambiguous"),
            )
            .filter((F.col("grain") != "three") | (F.col("n") >= F.least(self.share * F.col("parts"), F.lit(self.stretch))))
        )
        judged = shingled.groupBy("id").agg(
            F.collect_list(F.when((F.col("grain") == "word") & ~F.col("ambiguous"), F.struct("form", "original"))).alias("wholes"),
            F.collect_list(F.when((F.col("grain") == "run") & ~F.col("ambiguous"), F.struct("form", "original"))).alias("runs"),
            F.collect_list(
                F.when(F.col("grain").isin("pair", "bounded") & ~F.col("ambiguous"), F.struct("grain", "form", "original", "chain"))
            ).alias("pairs"),
            F.array_distinct(F.collect_list("chain")).alias("chains"),
        )
        return self.distinct.select("id", "word").join(judged, "id").drop("id")

    def found(self) -> DataFrame:
        """``doc_id`` of every document with a garbled word."""
        own = self.words.join(self.garbled_words().select("word"), "word", "left_semi").select("doc_id")
        return own.unionByName(self.together.select("doc_id")).distinct()

    def restored(self) -> DataFrame:
        """``doc_id, restored, n_garbled, n_restored`` of every document with a garbled word.

        A word is restored from its only original in the table, or by undoing a chain by which it was found, where
        garbling the result again gives the word; else it stays as it is.
        """

        def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(
                    {"word": batch["word"], "fixed": [_restore(*row) for row in batch.itertuples(index=False)]}
                )

        fixes = self.garbled_words().mapInPandas(fix, "word string, fixed string")
        own = self.words.select("doc_id", "word").join(fixes, "word")
        # Words that are garbled only in these documents.
        jointly = self.looked_up.filter("grain = 'word'").join(self.together.select("id").distinct(), "id", "left_semi")
        others = self._put_together(jointly).mapInPandas(fix, "word string, fixed string").join(self.distinct.select("id", "word"), "word")
        own = own.unionByName(self.together.join(others, "id").select("doc_id", "word", "fixed"))
        own = own.groupBy("doc_id", "word").agg(F.max("fixed").alias("fixed")).groupBy("doc_id").agg(F.collect_list(F.struct("word", "fixed")).alias("fixes"))

        def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc_id, text, fixes in batch.itertuples(index=False):
                    known = {f["word"]: f["fixed"] for f in fixes}
                    parts = [known.get(p) or p for p in re.split(f"({_BREAK})", text)]
                    out.append((doc_id, "".join(parts), len(known), sum(v is not None for v in known.values())))
                yield pd.DataFrame(out, columns=["doc_id", "restored", "n_garbled", "n_restored"])

        # Only the texts to rewrite are shuffled, if at all: their ids are few, or else the join is one by ids.
        own = cut(own)
        asked = F.broadcast(own) if own.count() <= self.few else own
        texts = self.texts.join(asked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "fixes")).alias("t"))
        return texts.select("doc_id", "t.*").mapInPandas(rewrite, "doc_id long, restored string, n_garbled int, n_restored int")


def _restore(word: str, wholes, runs, pairs, tried) -> str | None:
    """The original of a garbled word, or None."""
    # The longest form takes in most of the word's signs.
    for form, original in sorted(((w["form"], w["original"]) for w in wholes), key=lambda w: (-len(w[0]), w)):
        if not _LOST.search(original):
            return word.replace(form, original, 1)
    known = {r["form"]: r["original"] for r in runs}

    def fixed(run: str) -> str | None:
        return next((run.replace(form, known[form], 1) for form in bare(run) if form in known), None)

    pieces = _RUN.findall(word)
    if pieces and known and all(fixed(p) is not None for p in pieces) and any(p != fixed(p) for p in pieces):
        return _RUN.sub(lambda m: fixed(m.group()), word)
    for chain in tried:
        for pattern in (_WHOLE, _SEGMENT):
            plain = pattern.sub(lambda m: _undone(m.group(), chain), word)  # noqa: B023
            if plain != word and not unnatural(plain):
                return plain
    plain = word
    for pair in pairs:
        plain = _undone_within(plain, **{k: pair[k] for k in ("grain", "form", "original", "chain")})
    return plain if plain != word and not unnatural(plain) else None


def _undone_within(word: str, grain: str, form: str, original: str, chain: str) -> str:
    """The word with the garbled stretch that begins with a pair's form undone, or the word itself."""
    if grain == "bounded":
        return word.replace(form.strip("\n"), original.strip("\n"))
    start = word.find(form)
    # What follows a stretch of UTF-8 is none, so the longest one that can be undone is the stretch.
    for end in range(min(len(word), start + 200), start + len(form) - 1, -1) if start >= 0 and chain.startswith("utf-8>") else ():
        plain = _undone(word[start:end], chain)
        if plain.startswith(original):
            return word[:start] + plain + word[end:]
    return word


def _undone(text: str, chain: str) -> str:
    """The text that garbling under the chain turns into ``text``, or ``text`` itself."""
    plain = undo(text, chain)
    if plain is None or text.isascii() or looks_garbled(plain):
        return text
    return plain if any(form == text for c, form in chains(plain) if c == chain) else text
