"""From words to the voice's tokens: sounds, readings, token ids, timings. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import rules

LONGEST_CHUNK, SPACE_ID = 508, 16


def _mapping(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def to_ipa(phones: Column) -> Column:
    """An array of phones with stress digits as one string of sounds."""

    def sound(phone: Column) -> Column:
        bare, stress = F.regexp_replace(phone, r"\d$", ""), F.regexp_extract(phone, r"(\d)$", 1)
        mark = F.when(stress == "1", "ˈ").when(stress == "2", "ˌ").otherwise("")
        long_ = F.element_at(_mapping(rules.LENGTHENED), bare)
        plain = F.coalesce(F.element_at(_mapping(rules.ARPA), bare), F.lit(""))
        body = F.when((bare == "AH") & (stress == "0"), "ə").when((stress != "0") & long_.isNotNull(), long_).otherwise(plain)
        return F.concat(mark, body)

    return F.array_join(F.transform(phones, sound), "")


def letter_sounds(word: Column) -> Column:
    """Sounds by spelling alone, for words that no lexicon has; a last e is silent in words longer than three letters."""
    spoken = F.when(F.length(word) > 3, F.regexp_replace(word, "e$", "")).otherwise(word)
    parts = F.regexp_extract_all(spoken, F.lit("(" + "|".join(a for a, _ in rules.SPELLINGS) + ")"), 1)
    sounds = F.array_join(F.transform(parts, lambda p: F.element_at(_mapping(dict(rules.SPELLINGS)), p)), "")
    return F.when(F.size(parts) > 0, F.concat(F.lit("ˈ"), sounds)).otherwise("")


def folded(word: Column) -> Column:
    """Lower case, letters without their marks (by decomposition of Latin letters), special letters spelt out."""
    plain = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiiijklllnnnooorrrssssttuuuuuuwyzzz"
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďĕėęěēĝğġģĥĩīĭįǐĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
    out = F.translate(F.regexp_replace(F.lower(word), r"\p{Mn}", ""), marked, plain)
    for letter, spelt in rules.FOLDED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelt))
    return out


def reading(word: Column, previous: Column) -> Column:
    """The phones (one string) of a word with two readings, by the word before it; null leaves it to the lexicon."""
    after = lambda cues: F.coalesce(previous.isin(cues), F.lit(False))
    noun, verb = (_mapping({w: r[k] for w, r in rules.READINGS.items() if r[k]}) for k in (0, 1))
    first, second = F.element_at(noun, word), F.element_at(verb, word)
    return (
        F.when(word == "read", F.when(after(rules.PAST_CUES), first).when(after(rules.VERB_CUES), second))
        .when(word == "live", F.when(after(rules.DETERMINERS), first).otherwise(second))
        .when(after(rules.DETERMINERS), first)
        .when(after(rules.VERB_CUES), second)
    )


TOKEN = r"(\p{L}[\p{L}\p{M}\p{N}_']*|'\p{L}[\p{L}\p{N}_']*|[.,;:!?—…\"()])"


def token_rows(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, pos, token, key, previous): words and marks in order; previous is the folded word before, marks aside."""
    rows = docs.select(by, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), 1)).alias("pos", "token"))
    rows = rows.withColumn("key", F.when(F.col("token").rlike(r"\p{L}"), folded(F.col("token"))))
    last = F.last("key", ignorenulls=True).over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("previous", last)


def phonemized(docs: DataFrame, lexicon: DataFrame | None = None, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, ipa, misses): each text's sounds. lexicon: (word, phones), one row a word; words it lacks are spelt out."""
    rows = token_rows(docs, by, text).withColumn("chosen", reading(F.col("key"), F.col("previous")))
    if lexicon is None:
        rows = rows.withColumn("phones", F.lit(None).cast("string"))
    else:
        rows = rows.join(lexicon.select(F.col("word").alias("key"), "phones"), "key", "left")
    phones = F.coalesce("chosen", "phones")
    said = F.when(F.col("key").isNull(), F.col("token")).when(phones.isNotNull(), to_ipa(F.split(phones, " "))).otherwise(letter_sounds(F.col("key")))
    missed = F.col("key").isNotNull() & phones.isNull()
    whole = rows.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))).alias("all"), F.sum(missed.cast("long")).alias("misses")
    )
    joined = F.array_join(F.transform("all", lambda x: x["said"]), " ")
    return whole.select(by, F.regexp_replace(joined, r"\s+([.,;:!?…])", "$1").alias("ipa"), "misses")


def ligatures(ipa: Column) -> Column:
    for two, one in rules.LIGATURES:
        ipa = F.replace(ipa, F.lit(two), F.lit(one))
    return ipa


def token_ids(ipa: Column, vocabulary: dict[str, int]) -> Column:
    """Each character's id; characters that the vocabulary lacks are dropped."""
    return F.filter(F.transform(F.split(ipa, ""), lambda c: F.element_at(_mapping(vocabulary), c)), lambda i: i.isNotNull())


def chunks(ids: Column, limit: int = LONGEST_CHUNK, space: int = SPACE_ID) -> Column:
    """Runs of at most `limit` ids, cut before the last space in a run's second half, which starts the next run."""
    start = F.struct(F.array().cast("array<array<int>>").alias("out"), ids.alias("rest"))
    most = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(2 * F.size(ids) / limit).cast("int") + 1))

    def cut(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        window = F.slice(rest, 1, limit)
        back = F.array_position(F.reverse(F.slice(window, limit // 2 + 1, limit)), F.lit(space)).cast("int")
        size = F.when(F.size(rest) <= limit, F.size(rest)).when(back > 0, limit - back).otherwise(limit)
        return F.when(F.size(rest) == 0, acc).otherwise(
            F.struct(F.concat(acc["out"], F.array(F.slice(rest, 1, size))).alias("out"), F.slice(rest, size + 1, F.greatest(F.size(rest), F.lit(1))).alias("rest"))
        )

    return F.aggregate(most, start, cut, lambda acc: acc["out"])


def bounded(ids: Column) -> Column:
    return F.concat(F.array(F.lit(0)), ids, F.array(F.lit(0)))


def style_row(n_tokens: Column, rows: int, dialect: str = "blocktext") -> Column:
    if dialect == "offsets":
        return F.greatest(F.lit(0), F.least(n_tokens, F.lit(rows - 1)))
    return F.least(F.greatest(n_tokens, F.lit(1)), F.lit(rows)) - 1


def padded_ids(ids: Column, start: int = 1, end: int = 2, pad: int = 0) -> Column:
    """Start, then each id followed by padding, then the end."""
    return F.concat(F.array(F.lit(start)), F.flatten(F.transform(ids, lambda i: F.array(i, F.lit(pad)))), F.array(F.lit(end)))


def voice_rate(speed: Column) -> Column:
    """A system voice's rate, -10 to 10, that comes nearest a speed; a step is a factor of 1.1176."""
    return F.greatest(F.lit(-10), F.least(F.lit(10), F.bround(F.log(speed) / F.log(F.lit(1.1176))).cast("int")))


def clamped_speed(speed: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.5), F.least(F.lit(4.0), speed)) * 20) / 20


def stamp_seconds(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO time, 0 if it can't be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(stamp)), F.lit(0)).cast("long")
