"""String models: the splitter, token, phrase, delimiter, length and character statistics, prefix deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters by number; 6 stands for none.
DELIMITERS = "/ #-_."
# Two rank-1 words, the odd last one, or the tail. It looks behind so that no search starts inside a word: linear in the text.
_PIECE = "(?<![^/ #])[^/ #]*(?:[/ #]+(?:[^/ #]+[/ #]+)?|\\z)"


def rank1_pieces(text: Column) -> Column:
    """Words that end at a run of / space #, each with the run's earlier delimiters inside it."""
    pieces = F.regexp_extract_all(text, F.lit("(?<![^/ #])[^/ #]*[/ #]+"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.substr(p, F.lit(1), F.length(p) - 1).alias("word"), F.right(p, F.lit(1)).alias("delimiter")))


def tail_pieces(text: Column) -> Column:
    """Words after the last / space #: split at - _ . and between lower and upper case or letter and digit."""
    tail = F.regexp_replace(text, "\\A(?s:.*[/ #])", "")
    cut = F.regexp_replace(F.regexp_replace(tail, "([a-z])([A-Z])", "$1\u0001$2"), "([A-Za-z])([0-9])", "$1\u0001$2")
    pieces = F.regexp_extract_all(cut, F.lit("(?<![^-_.\u0001])[^-_.\u0001]*(?:\u0001|[-_.]+)"), F.lit(0))
    words = F.transform(
        pieces,
        lambda p: F.struct(
            F.substr(p, F.lit(1), F.length(p) - 1).alias("word"), F.when(F.right(p, F.lit(1)) == "\u0001", "").otherwise(F.right(p, F.lit(1))).alias("delimiter")
        ),
    )
    rest = F.regexp_replace(cut, "\\A(?s:.*[-_.\u0001])", "")
    return F.concat(words, F.array(F.struct(rest.alias("word"), F.lit("").alias("delimiter"))))


def split_words(text: Column) -> Column:
    """All words of a text with their delimiters; none for the empty text."""
    return F.when(text == "", F.array().cast("array<struct<word:string,delimiter:string>>")).otherwise(F.concat(rank1_pieces(text), tail_pieces(text)))


def piece_counts(df: DataFrame, text: str) -> DataFrame:
    """(piece, tail, cnt): the texts cut into the pairs (0, 1), (2, 3) ... of rank-1 words, an odd last one, and the tail.

    A pair is both words with all delimiters but the last, so that it tells its words and is the phrase; a tail is
    what follows the last delimiter, maybe empty. One pass gives the words and the phrases.
    """
    each = df.where(F.col(text) != "").select(F.explode(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))).alias("p"))
    ends = F.col("p").endswith(" ") | F.col("p").endswith("/") | F.col("p").endswith("#")
    piece = F.when(ends, F.substr("p", F.lit(1), F.length("p") - 1)).otherwise(F.col("p"))
    return each.groupBy(piece.alias("piece"), (~ends).alias("tail")).agg(F.count("*").alias("cnt"))


def _head(piece: Column) -> Column:
    """A pair's first word with its delimiters; empty if the piece is no pair."""
    return F.regexp_extract(piece, "^[^/ #]*[/ #]+(?=[^/ #])", 0)


def phrases_of(pieces: DataFrame) -> DataFrame:
    """(phrase, cnt) of the pieces that are pairs."""
    return pieces.where(_head(F.col("piece")) != "").select(F.col("piece").alias("phrase"), "cnt")


def words_of(pieces: DataFrame) -> DataFrame:
    """(word, cnt, used): the pieces' words; used is how often they stand in frequent phrases."""
    head = pieces.withColumn("head", _head(F.col("piece")))
    both = F.array(F.substr("head", F.lit(1), F.length("head") - 1), F.substr("piece", F.length("head") + 1))
    tail = F.transform(tail_pieces(F.col("piece")), lambda p: p["word"])
    words = F.when(F.col("tail"), tail).when(F.col("head") != "", both).otherwise(F.array("piece"))
    used = F.when((F.col("head") != "") & _frequent_phrase("piece"), F.col("cnt")).otherwise(0)
    each = head.select(F.explode(words).alias("word"), "cnt", used.alias("used"))
    return each.groupBy("word").agg(F.sum("cnt").alias("cnt"), F.sum("used").alias("used"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, cnt) over all texts."""
    return words_of(piece_counts(df, text)).select("word", "cnt")


def phrase_counts(df: DataFrame, text: str) -> DataFrame:
    """(phrase, cnt) of the pairs (0, 1), (2, 3) ... of rank-1 words with the delimiter between them."""
    return phrases_of(piece_counts(df, text))


def frequent_words(counts: DataFrame) -> DataFrame:
    size = F.octet_length("word")
    return counts.where(((F.col("cnt") > 3) & (size > 3)) | (F.col("cnt") > 10))


def _frequent_phrase(phrase: str) -> Column:
    return (F.col("cnt") > 10) & (F.octet_length(phrase) >= 3)


def frequent_phrases(counts: DataFrame) -> DataFrame:
    return counts.where(_frequent_phrase("phrase"))


def global_dictionary(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(kind, term, cnt): frequent phrases (0), then words still frequent (1) without those phrases' uses.

    ``words`` is (word, cnt, used) as words_of gives it, ``phrases`` is (phrase, cnt).
    """
    left = words.select("word", (F.col("cnt") - F.col("used")).alias("cnt"))
    top = frequent_phrases(phrases).select(F.lit(0).alias("kind"), F.col("phrase").alias("term"), "cnt")
    return top.union(frequent_words(left).select(F.lit(1), "word", "cnt"))


def term_members(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, known): whether the dictionary of ``global_dictionary`` has the word, by a join."""
    known = dictionary.where("kind = 1").select(F.col("term").alias("word"), F.lit(True).alias("known"))
    return words.select("word").join(known, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


def phrase_members(phrases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(phrase, known): whether the dictionary of ``global_dictionary`` has the phrase, by a join."""
    known = dictionary.where("kind = 0").select(F.col("term").alias("phrase"), F.lit(True).alias("known"))
    return phrases.select("phrase").join(known, "phrase", "left").select("phrase", F.coalesce("known", F.lit(False)).alias("known"))


def delimiter_histogram(df: DataFrame, text: str) -> DataFrame:
    """(delimiter, cnt) by the delimiter's number."""
    each = df.select(F.explode(split_words(F.col(text))).alias("t")).select("t.delimiter")
    number = F.when(F.col("delimiter") == "", 6).otherwise(F.instr(F.lit(DELIMITERS), F.col("delimiter")) - 1)
    return each.groupBy(number.cast("long").alias("delimiter")).agg(F.count("*").alias("cnt"))


def words_per_text(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(F.size(split_words(F.col(text))).cast("long").alias("n_words")).agg(F.count("*").alias("cnt"))


def word_lengths(df: DataFrame, text: str) -> DataFrame:
    words = df.select(F.explode(split_words(F.col(text))).alias("t"))
    return words.groupBy(F.octet_length("t.word").cast("long").alias("bytes")).agg(F.count("*").alias("cnt"))


def char_transitions(df: DataFrame, text: str) -> DataFrame:
    """(context, chr, cnt): 0 at the start or after a non-letter, 1..26 after a letter (ASCII texts)."""
    chars = F.split(F.col("t.word"), "")
    words = df.select(F.explode(split_words(F.col(text))).alias("t")).where("t.word <> ''").select(chars.alias("c"))
    each = words.select(F.posexplode("c").alias("i", "chr"), "c")
    before = F.lower(F.get("c", F.col("i") - 1))
    context = F.when(before.rlike("^[a-z]$"), F.ascii(before) - 96).otherwise(0)
    return each.groupBy(context.cast("long").alias("context"), "chr").agg(F.count("*").alias("cnt"))


def prefix_delta(now: Column, before: Column, most: int = 129, least: int = 5) -> Column:
    """Length of the common prefix with the string before: most at most, 0 if under least."""
    step = lambda a, i: F.when((a == i - 1) & (i <= F.length(now)) & (i <= F.length(before)) & (F.substr(now, i, F.lit(1)) == F.substr(before, i, F.lit(1))), i).otherwise(a)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), step)
    return F.when(before.isNull() | (same < least), 0).otherwise(same).cast("long")


def encoding_methods(counts: DataFrame) -> DataFrame:
    """(method, cnt): uses of words that the dictionary holds (2), and of those that are spelled out (0)."""
    size = F.octet_length("word")
    held = ((F.col("cnt") > 3) & (size > 3)) | (F.col("cnt") > 10)
    return counts.groupBy(F.when(held, 2).otherwise(0).cast("long").alias("method")).agg(F.sum("cnt").alias("cnt"))


def clamped_lengths(df: DataFrame, text: str, most: int = 63) -> DataFrame:
    """(bytes, cnt): lengths in bytes, ``most`` for all longer ones."""
    return df.groupBy(F.least(F.octet_length(text), F.lit(most)).cast("long").alias("bytes")).agg(F.count("*").alias("cnt"))
