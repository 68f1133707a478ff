"""Text expressions that stay in the JVM: cleaning, terms, variants, counts, references, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, and words that carry no meaning in a question.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
STOP_WORDS = (
    "a an and are as at be by can could did do does for from had has have how in into is it its of on or should that the their there these this those to "
    "was were what when where which why with would explain describe define tell about give me please show using use"
).split()
# Words that make no key concept, and parts of sentences that make no summary.
CONCEPT_STOP_WORDS = (
    "about after also because between chapter could every content from have into more page section should that their there these this through using were "
    "which with within would above below outlined source document material information example examples"
).split()
GENERIC_SUMMARY = ["what i have outlined", "the content above", "this content", "source page", "uploaded pdf", "chunk", "metadata"]
# Patterns of terms.
TERM = r"[a-z0-9֐-׿]+"
PLAIN_TERM = r"[A-Za-z0-9_]+"
WORD = r"[\p{L}\p{N}_]+"
CONCEPT = r"[A-Za-z֐-׿][A-Za-z0-9֐-׿-]{4,}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Text with each run of white space as one blank and none at the ends; null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def clean_markup(c: Column | str) -> Column:
    """Lines without tags, repeated bars and doubled blanks; lines with fewer than two letters or digits are dropped."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\|{2,}", "|"), r"[ \t]+", " ")
    lines = F.transform(F.split(t, r"\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ |]+|[ |]+$", ""))
    return F.array_join(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 2), "\n")


def terms(c: Column | str) -> Column:
    """Meaningful terms in order, repeated ones too: longer than one character and no stop word."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS))


def plain_terms(c: Column | str) -> Column:
    """All ASCII terms in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(PLAIN_TERM), F.lit(0)), F.lower)


def blank_words(c: Column | str) -> Column:
    """Words between white space, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+"), lambda x: x != "")


def variants(token: Column) -> Column:
    """A term with its singular or plural, and its number as word or digits."""
    number = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS, 1) for x in (w, str(i))], *[F.lit(x) for i, w in enumerate(NUMBER_WORDS, 1) for x in (str(i), w)])
    other = F.when(token.endswith("s") & (F.length(token) > 3), F.substring(token, F.lit(1), F.length(token) - 1)).when((F.length(token) > 2) & token.rlike("^[a-z]+$"), F.concat(token, F.lit("s")))
    return F.array_compact(F.array(token, other, F.try_element_at(number, F.regexp_replace(token, r"^0+(?=\d)", ""))))


def word_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(WORD), F.lit(0)))


def difficulty(c: Column | str) -> Column:
    """Easy, Medium or Hard by the mean word length and the share of words of ten characters or more."""
    words = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda x: x != "")
    n = F.size(words)
    mean = F.aggregate(words, F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(n, F.lit(0))
    share = F.size(F.filter(words, lambda x: F.length(x) >= 10)) / F.nullif(n, F.lit(0))
    return F.when(n == 0, "Easy").when((mean > 6.3) | (share > 0.22), "Hard").when((mean > 5.2) | (share > 0.12), "Medium").otherwise("Easy")


def multiplier(level: Column) -> Column:
    return F.when(level == "Easy", 1.0).when(level == "Hard", 1.45).otherwise(1.2)


def sentences(c: Column | str, least_words: int = 1, at_lines: bool = False) -> Column:
    """Sentences of at least so many words, white space tidied; also cut at line ends if asked."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?])\s+|\n+" if at_lines else r"(?<=[.!?])\s+")
    tidy = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(tidy, lambda x: (x != "") & (F.size(F.split(x, " ")) >= least_words))


def title_case(c: Column | str) -> Column:
    """Without a leading number; words not all in capitals get one at their beginning."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"^\d+(\.\d+)*\s*", ""), r"^[ :\-]+|[ :\-]+$", "")
    word = lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(F.transform(F.filter(F.split(t, r"\s+"), lambda w: w != ""), word), " ")


def _capital_share(line: Column) -> Column:
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    return F.length(F.regexp_replace(letters, "[^A-Z]", "")) / F.nullif(F.length(letters), F.lit(0))


def boundary_heading(line: Column) -> Column:
    """Whether a tidy line starts a chapter, section or the like."""
    n = F.size(F.split(line, " "))
    numbered = line.rlike(r"(?i)^(chapter|lecture|section|unit|module)\s+\d+(\.\d+)?\b") | line.rlike(r"^\d+(\.\d+)+\s+[A-Za-z֐-׿]") | line.rlike(r"^\d+\s+[A-Z][A-Za-z][^\n]{2,80}$")
    return (line != "") & (F.length(line) <= 100) & (numbered | (n.between(2, 9) & F.coalesce(_capital_share(line) > 0.65, F.lit(False))))


def title_heading(line: Column) -> Column:
    """Whether a tidy line may be a title."""
    n = F.size(F.split(line, " "))
    return (line != "") & (F.length(line) <= 90) & n.between(2, 10) & (line.rlike(r"^\d+(\.\d+)*\s+[\p{L}\p{N}_]+") | F.coalesce(_capital_share(line) > 0.45, F.lit(False)))


def lines(c: Column | str) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), r"\r\n|\r|\n")


def starts_with_heading(c: Column | str, first: int = 8) -> Column:
    return F.exists(F.slice(lines(c), 1, first), lambda x: boundary_heading(clean(x)))


def numbered_references(c: Column | str, labels: list[str], hebrew: list[str]) -> Column:
    """Sorted numbers from 1 to 99 named after a label, such as chapter 3, chapters 2-4, section two and five."""
    number = r"(?:\d{1,2}|" + "|".join(NUMBER_WORDS) + ")"
    text = F.lower(F.coalesce(col(c), F.lit("")))
    pattern = r"(?U)\b(?:" + "|".join(labels + hebrew) + rf")\.?\s+({number})(?:\s*(?:-|to|and|&)\s*({number}))?"
    value = lambda x: F.coalesce(F.expr("null").cast("int"), F.try_to_number(F.when(x.rlike(r"^\d+$"), x), F.lit("99")).cast("int"), F.nullif(F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), x), F.lit(0)).cast("int"))
    first, second = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), value) for i in (1, 2))
    both = F.zip_with(first, second, lambda a, b: F.when((b > a) & (b - a <= 10), F.sequence(a, F.greatest(a, b))).otherwise(F.array_compact(F.array(a, b))))
    parts = F.flatten(both)
    if hebrew:
        more = r"(?:" + "|".join(hebrew) + r")\s+(\d{1,2})(?:\s*(?:-|ו|and)\s*(\d{1,2}))?"
        parts = F.concat(parts, *[F.transform(F.regexp_extract_all(text, F.lit(more), F.lit(i)), value) for i in (1, 2)])
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.between(1, 99))))


def ellipsis(c: Column | str, most: int, keep: int | None = None) -> Column:
    """Text cut to ``keep`` characters (by default three fewer than ``most``) and three dots where longer than ``most``."""
    t = col(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3 if keep is None else keep)), F.lit("..."))).otherwise(t)


def excerpt(c: Column | str, most: int | Column) -> Column:
    """The text, or parts of its beginning, middle and end at whole words where it is longer than ``most``."""
    t = clean(c)
    most = F.lit(most) if isinstance(most, int) else most
    part = F.greatest(F.lit(180), F.floor(most / 3)).cast("int")
    drop_last = lambda x: F.regexp_replace(x, r" [^ ]*$", "")
    drop_first = lambda x: F.regexp_replace(x, r"^[^ ]* ", "")
    half = F.floor(F.length(t) / 2) - F.floor(part / 2)
    middle = F.trim(F.substring(t, F.greatest(F.lit(0), half).cast("int") + 1, part))
    return F.when(F.length(t) <= most, t).otherwise(F.concat_ws("\n...\n", F.rtrim(drop_last(F.substring(t, F.lit(1), part))), F.trim(drop_last(drop_first(middle))), F.trim(drop_first(F.substring(t, -part, part)))))


def query_intent(c: Column | str) -> Column:
    """chapter_summary, section_summary, study_plan, general_pdf_summary, factual_question or unknown, in this order."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    summary = t.rlike(r"\b(summarize|summary|explain|overview)\b|סכם|סיכום")
    idea = t.rlike(r"\b(main ideas?|key ideas?|main points?|about)\b|רעיון מרכזי")
    chapter = F.size(numbered_references(c, ["chapter", "chapters", "ch"], ["פרק", "פרקים"])) > 0
    section = F.size(numbered_references(c, ["section", "sections"], ["חלק"])) > 0
    return (
        F.when(chapter & (summary | idea | t.rlike("chapter|פרק")), "chapter_summary")
        .when(section & (summary | idea | t.rlike("section|חלק")), "section_summary")
        .when(t.rlike(r"\b(study plan|prepare for|help me study)\b|תוכנית לימוד"), "study_plan")
        .when((t.rlike(r"\b(pdf|document|material)\b") & (summary | idea)) | t.rlike("מהמסמך|מהחומר"), "general_pdf_summary")
        .when(F.trim(t) != "", "factual_question")
        .otherwise("unknown")
    )


def json_part(c: Column | str) -> Column:
    """JSON without fences around it, from the first brace or bracket to the last; null where there is none."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.nullif(F.regexp_extract(t, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def tidy_list(c: Column, most: int = 5, longest: int = 140) -> Column:
    """Distinct non-blank strings with white space tidied, the first ``most``, each cut to ``longest`` characters."""
    return F.transform(F.slice(F.array_distinct(F.filter(F.transform(c, clean), lambda x: x != "")), 1, most), lambda x: F.substring(x, 1, longest))
