"""Quality rules: a threshold table compiled into one projection; no user function, no shuffle.

A text is read once into words and lines, and every measure is a built-in expression over them. ``RULES`` names the
ratios and the range each must lie in; ``verdict`` turns the table into one boolean expression. Rules on the length and
the choice of words say nothing of a text that is mostly in a script without a list of function words here, or written
without spaces: there they are left out, and the others decide.

Defined cases: a very long text is read whole within its row; a null or blank text has no words, fails the base rule and is not kept; equal rows get equal results;
other columns of the table are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listingspark.functions.rows import with_once

from .texts import SPACE, own_columns, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# The most frequent function words by language. Single Latin letters are left out, as junk has them too.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all",
    "de": "der die und das von zu mit sich des auf ist im dem nicht ein eine auch es an werden aus er hat dass sie nach wird bei",
    "fr": "le la les et des en un une du que est pour qui dans ce il au sur pas plus par avec ne se sont",
    "es": "el los las y del se con por para su al lo como más pero sus le o este sí porque esta entre",
    "it": "di che il la per un una non con del della sono dei nel alla più le gli come anche dal ma",
    "pt": "de que não uma para com os as do da dos das em um por mais como mas foi ao ele seu sua ou",
    "nl": "de het een van en dat niet te zijn op voor met die aan er om ook als bij maar uit naar",
    "sv": "och att det som en på är av för med den till inte har de ett om var jag men",
    "da": "og at det er en til af på for ikke med den der de et har som fra var men",
    "nb": "og det er på som av ikke med for den til en et har om var at fra men",
    "fi": "ja on ei se että oli hän mutta kun niin myös joka ovat mitä tai kuin sen ole",
    "pl": "się na nie do jest to że jak ale po co tak od za przez dla był oraz przy",
    "cs": "se na je že to ve do za po jsou ale jako od pro při byl podle nebo jen která",
    "sk": "sa na je že to vo do za po sú ale ako od pre pri bol podľa alebo len ktorá",
    "hu": "az és hogy nem is egy ez meg volt csak de már mint vagy még van ha el",
    "ro": "și de la în cu nu că pe din este pentru mai sau care un au fost fi ca",
    "hr": "je da se na su za od što kao ali iz bio sam nije ili koji po ne",
    "tr": "ve bir bu da de için ile çok ne daha olarak gibi kadar olan sonra var ama en",
    "vi": "và của là có không được cho một các trong người với này đã để những khi như",
    "id": "yang dan di ini itu dengan untuk dari tidak dalam pada adalah akan ke ada juga atau oleh",
    "sw": "na ya wa kwa ni katika za la kuwa hii huo pia au lakini kama hivyo",
    "ru": "и в не на что с по это как он из за то к от для был но у о же его все так они мы или при",
    "uk": "і в не на що з та у до як це за по для від є але він про його або вони так був при",
    "bg": "и на да се в за от е с не са че по като това до или които беше но при",
    "sr": "и је да се у на су за од не са што као али из био или који по",
    "el": "και το να του η της με που την από για τα είναι των σε ο οι στο θα τη στην ότι δεν τον ένα μια",
    "ar": "في من على إلى أن التي الذي عن مع هذا هذه كان ما لا كل بين ذلك قد أو هو هي لم بعد ثم كما حتى كانت",
    "fa": "و در به از که این را با است آن برای یک بر تا خود هم می شد بود ها یا",
    "ur": "کے میں کی ہے اور سے کا کو اس کہ پر نے ہیں یہ ایک بھی نہیں تھا کر",
    "he": "של את על לא זה הוא עם היא גם או כי אל יש היה אני כל אם רק אבל",
    "hi": "के में की है और से को का पर ने हैं कि यह एक भी नहीं तो ही था लिए इस कर या",
    "bn": "এবং ও এই যে থেকে করে না তার একটি জন্য হয় ছিল এক সঙ্গে কিন্তু তা বা",
    "ta": "ஒரு என்று இந்த மற்றும் அந்த என இது உள்ள அவர் போன்ற ஆனால் அல்லது",
    "ko": "이 그 및 수 있는 것은 있다 등 더 한 또한 그리고 것이다 위해 대한 하는",
    "ka": "და არ რომ ეს ის იყო არის მაგრამ თუ რა ან მას",
    "hy": "և է են որ մի այս ու իր չի համար նա էր բայց կամ",
}
#: As they stand, at the beginning of a sentence and in capitals: words are compared as they are.
STOP_WORDS = list(dict.fromkeys(form for text in FUNCTION_WORDS.values() for w in text.split() for form in (w, w.capitalize(), w.upper())))

# First and last code points of scripts whose languages have no list above: Gurmukhi to Oriya, Telugu to Sinhala,
# Thai to Tibetan, Myanmar, Ethiopic, Khmer, Mongolian, kana, and Han in three parts.
UNLISTED_SCRIPTS = (
    (0x0A00, 0x0B7F), (0x0C00, 0x0DFF), (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1200, 0x137F), (0x1780, 0x17FF), (0x1800, 0x18AF),
    (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF),
)
UNLISTED = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNLISTED_SCRIPTS) + "]"
#: Rules that need words told apart, in a language of the lists; left out where more than half the characters are of other scripts.
WORDWISE = ("mean_word_chars", "stop_word_share")

#: measure, least, most: a text whose measure lies outside is rejected (None: no bound).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.15),
    ("stop_word_share", 0.03, None),
    ("dup_line_share", None, 0.4),
    ("stutter_share", None, 0.2),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` with counts and ratios of each text."""
    text = F.coalesce("text", F.lit(""))
    return _measured(own_columns(docs, "doc_id", "text").select("doc_id", text.alias("text")))


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` with measures instead of ``text``."""
    rows = with_once(rows, _words=words(F.col("text")), _lines=F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACE}]")))
    rows = with_once(
        rows,
        _windows=F.transform("_words", lambda w: F.xxhash64(w)),
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_stop=F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long"),
        n_symbols=F.regexp_count(F.col("text"), F.lit("[#*$%&|<>]")).cast("long"),
        n_unlisted=F.regexp_count(F.col("text"), F.lit(UNLISTED)).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    ).drop("_words", "_lines", "text")
    stutter = F.size(F.filter("_windows", lambda h, i: h == F.get("_windows", i - 1)))
    rows = with_once(rows, n_stutter=stutter.cast("long"), _windows=_pairs(F.col("_windows"), 1))
    for half in (2, 4):  # from hashes of 2 words in a row to those of 4 and 8
        rows = with_once(rows, _windows=_pairs(F.col("_windows"), half))
    # alone, as array_distinct is compiled only in a step without lambdas
    rows = with_once(rows, _distinct=F.size(F.array_distinct("_windows")))
    repeated = F.when(F.col("_distinct") == F.size("_windows"), F.lit(0)).otherwise(_covered(F.col("_windows")))
    rows = with_once(rows, n_repeat_words=repeated.cast("long")).drop("_windows", "_distinct")
    n = F.col("n_words")
    return rows.select(
        "*",
        _ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbols_per_word"),
        _ratio(F.col("n_stop"), n).alias("stop_word_share"),
        _ratio(F.col("n_unlisted"), F.col("word_chars")).alias("unlisted_share"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _ratio(F.col("n_stutter"), n).alias("stutter_share"),
    )


def _pairs(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one ``apart`` places later."""
    many = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, many), F.slice(hashes, apart + 1, many), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hash of the window at each word.

    Windows are sorted by hash and place, those with an equal neighbour stay, and their places, sorted again, each
    add the words up to the next one's, or a whole window.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(all_: Column) -> Column:
        same = lambda i, j: F.get(all_, i).h == F.get(all_, j).h
        kept = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda k: ((k > 0) & same(k, k - 1)) | ((k + 1 < F.size(all_)) & same(k, k + 1)))
        return F.array_sort(F.transform(kept, lambda k: F.get(all_, k).i))

    def total(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
            lambda s, p: F.struct(p.alias("last"), (s.sum + F.least(p - s.last, F.lit(WINDOW))).alias("sum")),
            lambda s: s.sum,
        )

    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluates the value once
    return bound(bound(placed, repeated), total)


def verdict(rules=RULES) -> Column:
    """The table as one condition."""
    other = F.col("unlisted_share") > 0.5
    bounds = [(name, F.col(name) >= least) for name, least, _ in rules if least is not None] + [(name, F.col(name) <= most) for name, _, most in rules if most is not None]
    return reduce(lambda a, b: a & b, [other | test if name in WORDWISE else test for name, test in bounds], F.lit(True))


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every text."""
    return _judged(measures(docs), rules)


def _judged(rows: DataFrame, rules) -> DataFrame:
    n = F.col("n_words")
    rows = rows.withColumn("base_failed", (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT))
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_rows(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns as they were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = _judged(_measured(whole.withColumn("text", F.coalesce(F.col("_row").getField("text"), F.lit("")))), rules)
    return rows.filter("kept").select("_row.*")
