"""Segmentation, sentences, chunk packing and tokens, as Column expressions.

Patterns are written for Java and RE2 alike, without look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polescale.config import CHUNK_WORDS, LONG_TEXT, MIN_PARAGRAPHS, WINDOW_SENTENCES

#: White space as Python's str.strip and str.split see it.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
SENTENCE_END = r"([.!?…]+)" + WS + "+"
TOKEN = r"(\p{L}{2,})"
MARK = "\x01"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def not_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def n_words(x: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.translate(x, SPACES, " " * len(SPACES)), " "), lambda w: w != ""))


def sentences(x: Column) -> Column:
    """Split after . ! ? … and white space; abbreviations split too, unlike a parser's sentences."""
    return not_blank(F.split(F.regexp_replace(x, SENTENCE_END, "$1" + MARK), MARK))


def paragraphs(x: Column) -> Column:
    return not_blank(F.split(x, r"\n" + WS + r"*\n"))


def lines(x: Column) -> Column:
    return not_blank(F.split(x, "\n"))


def windows(parts: Column, size: int = WINDOW_SENTENCES) -> Column:
    """All runs of ``size`` neighbours; needs at least that many parts."""
    return F.transform(F.sequence(F.lit(1), F.size(parts) - (size - 1)), lambda i: F.slice(parts, i, size))


def segment(text: Column, sentence_split=sentences) -> Column:
    """``struct<strategy, segments array<array<string>>>``: each segment is the list of its sentences.

    paragraphs: three or more blank-line paragraphs. single_newline: a long
    text of three or more lines. short: up to three sentences, one segment.
    sentence_window: runs of three sentences, step one.
    """
    raw = F.coalesce(text, F.lit(""))

    def strategy(paras: Column, rows: Column, sents: Column) -> Column:
        split_all = lambda parts: F.transform(parts, sentence_split)
        case = lambda name, seg: F.struct(F.lit(name).alias("strategy"), seg.alias("segments"))
        return (
            F.when(F.size(paras) >= MIN_PARAGRAPHS, case("paragraphs", split_all(paras)))
            .when((F.length(raw) > LONG_TEXT) & (F.size(rows) >= MIN_PARAGRAPHS), case("single_newline", split_all(rows)))
            .when(F.size(sents) <= WINDOW_SENTENCES, case("short", F.array(sents)))
            .otherwise(case("sentence_window", windows(sents)))
        )

    return let(paragraphs(raw), lambda p: let(lines(raw), lambda r: let(sentence_split(raw), lambda s: strategy(p, r, s))))


def pack(parts: Column, target: int = CHUNK_WORDS) -> Column:
    """Greedy packing of sentences to chunks of at most ``target`` words.

    A chunk ends when the next sentence would pass the target; a longer
    sentence is a chunk of its own. Blank sentences are skipped. A first pass
    numbers each sentence's chunk from its words alone, so that no pass
    carries texts along; then each chunk's sentences, a slice, are joined.
    """
    sized = F.filter(F.transform(not_blank(parts), lambda s: F.struct(s.alias("t"), n_words(s).alias("n"))), lambda s: s["n"] > 0)

    def starts(xs: Column) -> Column:
        """Places of the sentences that begin a chunk."""

        def step(acc: Column, n: Column) -> Column:
            full = (acc["k"] == 0) | (acc["n"] + n > target)
            return F.struct(F.when(full, F.concat(acc["at"], F.array(acc["k"]))).otherwise(acc["at"]).alias("at"), (acc["k"] + 1).alias("k"), F.when(full, n).otherwise(acc["n"] + n).alias("n"))

        none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("k"), F.lit(0).alias("n"))
        return F.aggregate(F.transform(xs, lambda s: s["n"]), none, step, lambda a: a["at"])

    def cut(xs: Column, at: Column) -> Column:
        texts = F.transform(xs, lambda s: s["t"])
        end = lambda i: F.coalesce(F.get(at, i + 1), F.size(xs))
        return let(texts, lambda t: F.transform(at, lambda a, i: F.array_join(F.slice(t, a + 1, end(i) - a), " ")))

    return let(sized, lambda xs: let(starts(xs), lambda at: cut(xs, at)))


def word_slices(text: Column, target: int = CHUNK_WORDS) -> Column:
    """Fixed slices of ``target`` words, for a text without sentences."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / target).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * target + 1, target), " "))
    return let(words, lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(F.array().cast("array<string>")))


def chunks(text: Column, target: int = CHUNK_WORDS, sentence_split=sentences) -> Column:
    """``array<string>``: all segments' chunks in order; fixed slices of a text in which the splitter finds no sentence."""
    packed = let(segment(text, sentence_split)["segments"], lambda segs: F.flatten(F.transform(segs, lambda s: pack(s, target))))
    return let(packed, lambda p: F.when(F.size(p) > 0, p).otherwise(word_slices(text, target)))


def words(text: Column) -> Column:
    """``array<string>``: the words of ``tokens``, all of which have the part of speech X."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def tokens(text: Column) -> Column:
    """``array<struct<word, pos>>``: lower-cased runs of two or more letters, with the part of speech X.

    The stand-in for a lemmatiser; one that tags words gives the same shape.
    """
    return F.transform(words(text), lambda w: F.struct(w.alias("word"), F.lit("X").alias("pos")))


def keep_lemmas(tagged: Column, pos: tuple[str, ...]) -> Column:
    """Of ``array<struct<lemma, pos, is_stop, is_punct, is_space>>`` the content lemmas as ``struct<word, pos>``, order and repeats kept."""
    kept = F.filter(tagged, lambda t: ~(t["is_stop"] | t["is_punct"] | t["is_space"]) & t["pos"].isin(*pos))
    return F.filter(F.transform(kept, lambda t: F.struct(F.lower(t["lemma"]).alias("word"), t["pos"].alias("pos"))), lambda t: F.length(t["word"]) >= 2)


def format_ci(point: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", F.coalesce(point, F.lit(0.0)), lo, hi)
