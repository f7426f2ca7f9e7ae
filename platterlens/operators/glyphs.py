"""Tables of shapes: observing and voting as aggregates, and readings of words settled by a list of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept
from . import voting

#: Letters as tall as an x, and capitals, whose heights tell one from the other.
X_HIGH, CAPITAL = "acemnorsuvwxz", "ACEMNORSUVWXZ"
#: Words that lists lack, and English forms that stand alone.
COMMON = "i a is it if in ill island all will well tell look like little last left life line list live long love let less later".split()
FORMS = ("I", "I'm", "I'll", "I've", "I'd")
#: What speaks for and against a reading.
FORM, BASE, WHOLE, SHOUTED, NOT_SHOUTED, CAPITAL_WITHIN, OPENING = 140, 100, 60, 25, -100, -35, 45
#: Fixed value: readings of a word from which structure alone decides.
MOST_READINGS = 64


def table_of(seen: DataFrame, agreement: float = 0.8, enough: int = 20) -> DataFrame:
    """(key, seen, first_cue, first_pos, votes, text, thin) of seen (key, cue, pos, label): a shape's row is made by its first
    sight and counts all; its labels are votes, settled as voting.settle does; thin shapes have fewer than `enough`."""
    first = seen.groupBy("key").agg(F.count("*").alias("seen"), F.min(F.struct("cue", "pos")).alias("first"))
    votes = seen.filter("label is not null").select("key", "label", F.lit(1).alias("n"))
    settled = voting.settle(votes, agreement=agreement)
    joined = first.join(settled.select("key", "text", "total"), "key", "left")
    n = F.coalesce("total", F.lit(0))
    return joined.select("key", "seen", F.col("first.cue").alias("first_cue"), F.col("first.pos").alias("first_pos"), n.alias("votes"), "text", (n < enough).alias("thin"))


def wrong_case(table: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Rows of table (by, text, h, seen) seen `least` times or more whose height is that of the other case, with the two
    median heights and the letter that it probably is. Heights are few, so the medians fold to counts."""
    of = F.when(F.length("text") == 1, F.when(F.instr(F.lit(X_HIGH), F.col("text")) > 0, "x").when(F.instr(F.lit(CAPITAL), F.col("text")) > 0, "cap"))
    rows = table.withColumn("__class", of)
    median = lambda c, name: voting.index_quantile(rows.filter(F.col("__class") == c).select(*by, F.col("h").alias(name)), by, name, 1, 2).drop("n")
    known = rows.join(median("x", "x_height"), by).join(median("cap", "cap_height"), by)
    off = F.when((F.col("__class") == "cap") & (F.col("h") <= F.col("x_height") + 1), F.lower("text")).when((F.col("__class") == "x") & (F.col("h") >= F.col("cap_height") - 1), F.upper("text"))
    found = known.filter((F.col("x_height") > 0) & (F.col("cap_height") > F.col("x_height")) & (F.col("seen") >= least)).withColumn("probably", off)
    return found.filter("probably is not null").drop("__class")


def taught(seen: DataFrame, answers: DataFrame) -> DataFrame:
    """(batch, lines, answers, accepted): how many lines of seen (batch, pos, key) a reader was asked and how many of answers (batch, pos,
    label) it gave; another number can't be laid beside the lines, so such a batch teaches nothing."""
    given = answers.groupBy("batch").agg(F.count("*").alias("answers"))
    n = F.coalesce("answers", F.lit(0).cast("long"))
    return seen.groupBy("batch").agg(F.count("*").alias("lines")).join(given, "batch", "left").select("batch", "lines", n.alias("answers"), (F.col("lines") == n).alias("accepted"))


def learned(shapes: DataFrame, answers: DataFrame, enough: int = 24, most: int = 1500, batch: int = 48) -> tuple[DataFrame, DataFrame]:
    """What reading a disc's own cues teaches: (stream, key, label, n) votes, and (stream, cue, batch_no) of the cues that were read.

    Of shapes (stream, cue, pos, key) a reader is asked for a cue while one of its shapes is thin, with fewer than `enough` votes,
    and fewer than `most` cues of the stream were read; answers (stream, cue, pos, label) are what it would say. Cues are read in
    batches of `batch`, and votes count from the next batch on, so a round takes of each stream the next cues that hold a shape
    still thin: all streams in one pass, and rounds only until every shape is well attested. A cue with more or fewer answers
    than shapes teaches nothing, but was read. shapes and answers are read in every round, so they should be tables or cheap to make.
    """
    spark = shapes.sparkSession
    of = shapes.schema["stream"].dataType.simpleString()
    # each cue once with its shapes, so that a round reads short rows and neither joins nor shuffles them
    sizes = shapes.groupBy("stream", "cue").agg(F.count("*").alias("__n"), F.count("key").alias("__known"), F.collect_set("key").alias("__keys"))
    given = answers.groupBy("stream", "cue").agg(F.count("*").alias("__m"))
    cues = kept(sizes.join(given, ["stream", "cue"], "left").select("stream", "cue", "__keys", (F.col("__known") < F.col("__n")).alias("__nameless"), F.coalesce(F.col("__n") == F.col("__m"), F.lit(False)).alias("__sound")), "cues")
    votes = spark.createDataFrame([], f"stream {of}, key {shapes.schema['key'].dataType.simpleString()}, label string, n long")
    read = spark.createDataFrame([], f"stream {of}, cue {shapes.schema['cue'].dataType.simpleString()}, batch_no int")
    for no in range(-(-most // batch)):
        thin = cues
        if no:
            # a stream's attested shapes are few: its votes, `most` cues' shapes, by `enough`
            attested = votes.groupBy("stream", "key").agg(F.sum("n").alias("__votes")).filter(F.col("__votes") >= enough).groupBy("stream").agg(F.collect_set("key").alias("__attested"))
            last = read.groupBy("stream").agg(F.max("cue").alias("__last"))
            ahead = cues.join(last.join(attested, "stream", "left"), "stream", "left").filter(F.col("__last").isNull() | (F.col("cue") > F.col("__last")))
            thin = ahead.filter(F.col("__attested").isNull() | F.col("__nameless") | (F.size(F.array_except("__keys", "__attested")) > 0))
        place = F.row_number().over(Window.partitionBy("stream").orderBy("cue"))
        now = kept(thin.withColumn("__at", place).filter(F.col("__at") <= min(batch, most - no * batch)).select("stream", "cue", F.lit(no).alias("batch_no"), "__sound"), "asked")
        if now.isEmpty():
            break
        asked = now.filter("__sound").select("stream", "cue")
        told = shapes.join(asked, ["stream", "cue"]).join(answers.join(asked, ["stream", "cue"]), ["stream", "cue", "pos"]).groupBy("stream", "key", "label").agg(F.count("*").alias("n"))
        # from the first round on both are small tables, which Spark knows
        votes = kept((votes.unionByName(told) if no else told).groupBy("stream", "key", "label").agg(F.sum("n").alias("n")), "votes")
        read = read.unionByName(now.drop("__sound")) if no else now.drop("__sound")
    return votes, read


def word_list(lists: DataFrame, english: bool) -> DataFrame:
    """(word) of lists (line): what stands before a slash, lower case, if it is two letters or more and nothing else."""
    word = F.lower(F.trim(F.substring_index("line", "/", 1)))
    words = lists.select(word.alias("word")).filter((F.length("word") > 1) & F.col("word").rlike(r"^\p{IsAlphabetic}+$"))
    extra = lists.sparkSession.createDataFrame([(w,) for w in COMMON if english], "word string")
    return words.unionByName(extra).distinct()


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}]", "")


def _first_reading(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: s[0]), "")


def _known(rows: DataFrame, keys: list[str], words: DataFrame) -> DataFrame:
    """rows (keys..., asked array<string>) with known: those of asked, lower case, that are words."""
    asked = rows.select(*keys, F.explode(F.transform("asked", F.lower)).alias("word")).distinct()
    found = asked.join(words, "word", "left_semi").groupBy(*keys).agg(F.collect_set("word").alias("known"))
    return rows.drop("asked").join(found, keys, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def split_near_misses(words_in: DataFrame, words: DataFrame) -> DataFrame:
    """(line, pos, part, slots) of words_in (line, pos, slots, gaps): a word that is none is split at the widest gap within
    two pixels of the threshold of which both sides are words, never beside an apostrophe."""
    side = lambda a, n: _first_reading(F.slice("slots", a, n))
    at = lambda i: F.struct(i.alias("i"), F.get("gaps", i)["gap"].alias("gap"), F.get("gaps", i)["threshold"].alias("threshold"), side(F.lit(1), i + 1).alias("left"), side(i + 2, F.size("slots")).alias("right"))
    ends = F.filter(F.transform(F.sequence(F.lit(0), F.size("slots") - 1), at), lambda e: (e.i < F.size("slots") - 1) & (e.threshold > 0) & (e.gap * 10 >= e.threshold * 10 - 20) & ~e.left.endswith("'") & ~e.right.startswith("'"))
    core = _letters(_first_reading(F.col("slots")))
    near = F.exists("gaps", lambda g: (g.threshold > 0) & (g.gap * 10 >= g.threshold * 10 - 20)) & (F.octet_length(core) >= 4)
    words_in = words_in.filter(F.size("slots") > 0)
    rows = words_in.filter(near).withColumns({"core": core, "ends": ends})
    asked = F.concat(F.array("core"), F.transform("ends", lambda e: _letters(e.left)), F.transform("ends", lambda e: _letters(e.right)))
    looked = _known(rows.withColumn("asked", asked), ["line", "pos"], words)
    is_word = lambda c: F.array_contains(F.col("known"), F.lower(c))
    good = lambda e: (_letters(e.left).isin("I", "l", "a", "A") | ((F.octet_length(_letters(e.left)) >= 2) & is_word(_letters(e.left)))) & (F.octet_length(_letters(e.right)) >= 2) & is_word(_letters(e.right))
    best = F.array_max(F.transform(F.filter("ends", lambda e: good(e) & ~is_word(F.col("core"))), lambda e: F.struct(e.gap.alias("gap"), (-e.i).alias("i"))))
    cut = looked.withColumn("cut", -best["i"] + 1)
    parts = F.when(F.col("cut").isNull(), F.array("slots")).otherwise(F.array(F.slice("slots", F.lit(1), F.col("cut")), F.slice("slots", F.col("cut") + 1, F.size("slots"))))
    whole = words_in.filter(~F.coalesce(near, F.lit(False))).select("line", "pos", F.lit(0).alias("part"), "slots")
    return cut.select("line", "pos", F.posexplode(parts).alias("part", "slots")).unionByName(whole)


def readings(slots: Column) -> Column:
    """All readings of a word: arrays of struct(c, fixed), one for each character, earlier slots varying fastest."""
    one = lambda text, n: F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), (n == 1).alias("fixed")))
    start = F.array(F.array().cast("array<struct<c:string,fixed:boolean>>"))
    return F.aggregate(slots, start, lambda done, s: F.flatten(F.transform(s, lambda r: F.transform(done, lambda d: F.concat(d, one(r, F.size(s)))))))


def _runs(chars: Column) -> Column:
    """Runs of letters and apostrophes."""
    kind = "array<struct<c:string,fixed:boolean>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("now"))
    add = lambda a, x: F.when(x.c.rlike(r"^[\p{IsAlphabetic}']$"), F.struct(a.done.alias("done"), F.array_append(a.now, x).alias("now"))).otherwise(F.struct(F.array_append(a.done, a.now).alias("done"), F.array().cast(kind).alias("now")))
    return F.filter(F.aggregate(chars, start, add, lambda a: F.array_append(a.done, a.now)), lambda r: F.size(r) > 0)


def _text(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda x: x.c), "")


def _scored(runs: DataFrame, words: DataFrame, english: bool) -> DataFrame:
    """runs (slots, i, run) with score: what speaks for one run of letters of reading i. Only settled letters say whether a
    word is shouted."""
    alphabetic = lambda x: x.c.rlike(r"^\p{IsAlphabetic}$")
    upper = lambda x: x.c.rlike(r"^\p{IsUppercase}$")
    rows = runs.withColumns({"core": F.trim(_text(F.col("run")), F.lit("'")), "settled": F.filter("run", lambda x: alphabetic(x) & x.fixed)})
    rows = rows.withColumns({"base": F.substring_index("core", "'", 1), "shouted": (F.size("settled") >= 2) & F.forall("settled", upper)})
    shouted = F.col("shouted")
    each = F.transform("run", lambda x, k: F.when(~alphabetic(x), 0).when(shouted & upper(x), SHOUTED).when(shouted, NOT_SHOUTED).when(upper(x) & (k > 0), CAPITAL_WITHIN).otherwise(0))
    rows = rows.select("slots", "i", "core", "base", F.lower("core").alias("core_key"), F.lower("base").alias("base_key"), F.aggregate(each, F.lit(0), lambda a, x: a + x).alias("case"))
    found = rows.join(words.select(F.col("word").alias("base_key"), F.lit(True).alias("base_known")), "base_key", "left").join(words.select(F.col("word").alias("core_key"), F.lit(True).alias("core_known")), "core_key", "left")
    by_words = F.when((F.octet_length("base") > 1) & F.col("base_known"), BASE).otherwise(0) + F.when((F.octet_length("core") > 1) & (F.col("core") != F.col("base")) & F.col("core_known"), WHOLE).otherwise(0)
    score = by_words + F.col("case")
    if english:
        score = F.when(F.col("core").isin(*FORMS), FORM).otherwise(score)
    return found.select("slots", "i", F.when(F.col("core") == "", 0).otherwise(score).alias("score"))


def _fallback(slots: Column, opening: bool, english: bool) -> Column:
    """By structure alone: small letters, but a capital where a sentence or, in English, a word of two opens."""
    starts = lambda x, kind: F.substring(x, 1, 1).rlike(rf"^\p{{Is{kind}}}$")
    pick = lambda s, kind: F.get(F.filter(s, lambda x: starts(x, kind)), F.lit(0))
    capital = lambda i: (i == 0) & (F.lit(opening) | (F.lit(english) & (F.size(slots) <= 2)))
    return F.array_join(F.transform(slots, lambda s, i: F.when(F.size(s) == 1, s[0]).when(capital(i), F.coalesce(pick(s, "Uppercase"), pick(s, "Lowercase"), s[0])).otherwise(F.coalesce(pick(s, "Lowercase"), pick(s, "Uppercase"), s[0]))), "")


def resolve_words(parts: DataFrame, words: DataFrame, english: bool) -> DataFrame:
    """parts (line, pos, part, slots) with opening and within: what each word reads as where a sentence opens with it, and
    elsewhere. slots: array of arrays of readings, one reading being settled.

    A word that is settled throughout reads as it stands. Readings of others are enumerated up to MOST_READINGS and looked
    up together, in one join with the list of words; of equal scores the first counts.
    """
    settled = F.forall("slots", lambda s: F.size(s) == 1)
    plain = parts.filter(settled).select("line", "pos", "part", _first_reading(F.col("slots")).alias("opening"), _first_reading(F.col("slots")).alias("within"))
    product = F.aggregate("slots", F.lit(1.0), lambda a, s: a * F.size(s))
    # a word is resolved once, however often it stands
    asked = parts.filter(~settled).select("slots").distinct()
    read = asked.filter(product <= MOST_READINGS).select("slots", F.posexplode(readings(F.col("slots"))).alias("i", "chars"))
    runs = read.select("slots", "i", F.explode(_runs(F.col("chars"))).alias("run"))
    first = F.get("chars", F.lit(0))["c"]
    case = F.when(first.rlike(r"^\p{IsUppercase}$"), OPENING).when(first.rlike(r"^\p{IsLowercase}$"), -OPENING).otherwise(0)
    bare = read.select("slots", "i", case.alias("case"), _text(F.col("chars")).alias("text"), F.lit(0).alias("score"))
    scored = bare.unionByName(_scored(runs, words, english).select("slots", "i", F.lit(None).cast("int").alias("case"), F.lit(None).cast("string").alias("text"), "score"))
    summed = scored.groupBy("slots", "i").agg(F.max("case").alias("case"), F.max("text").alias("text"), F.sum("score").alias("score"))
    best = lambda value: F.max(F.struct(value.alias("s"), (-F.col("i")).alias("i"), F.col("text").alias("t")))
    chosen = summed.groupBy("slots").agg(best(F.col("score") + F.col("case")).alias("o"), best(F.col("score")).alias("w")).select("slots", F.col("o.t").alias("opening"), F.col("w.t").alias("within"))
    many = asked.filter(product > MOST_READINGS).select("slots", _fallback(F.col("slots"), True, english).alias("opening"), _fallback(F.col("slots"), False, english).alias("within"))
    resolved = parts.filter(~settled).join(chosen.unionByName(many), "slots")
    return resolved.select("line", "pos", "part", "opening", "within").unionByName(plain)


def resolve_lines(words_in: DataFrame, lists: DataFrame, english: bool = True) -> DataFrame:
    """(line, text) of words_in (line, pos, slots, gaps), with lists (line) of words. A line is one value: its words are put
    in order, and each tells the next whether a sentence opens there."""
    words = word_list(lists, english)
    parts = kept(split_near_misses(words_in, words), "word-parts")  # four branches read them
    resolved = resolve_words(parts, words, english)
    sorted_parts = resolved.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "opening", "within"))).alias("parts"))
    ends = lambda text: F.rtrim(text, F.lit("\"')")).rlike(r"[.!?]$")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("opens"))

    def add(a: Column, p: Column) -> Column:
        # the second half of a split word never opens a sentence, and its end alone tells what follows
        text = F.when(a.opens & (p.part == 0), p.opening).otherwise(p.within)
        return F.struct(F.array_append(a.out, text).alias("out"), ends(text).alias("opens"))

    return sorted_parts.select("line", F.aggregate("parts", start, add, lambda a: F.array_join(a.out, " ")).alias("text"))
