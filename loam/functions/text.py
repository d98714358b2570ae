"""Column functions over text: estimates, splits, masks, patterns. All run inside the JVM.

Words are runs of letters, digits and underscores in any script. A null text
gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    return matches(F.lower(text), WORD)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def pieces(text: Column) -> Column:
    """White-space-separated pieces, empty ones left out."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


# ---- sizes

#: Code point ranges of each script, and characters in a token.
SCRIPTS = {
    "cyrillic": (r"[\x{0400}-\x{052F}]", 3.0),
    "latin": (r"[A-Za-z\x{00C0}-\x{024F}]", 4.0),
    "cjk": (r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]", 1.5),
}


def script_tokens(text: Column) -> Column:
    """Token estimate that weighs characters by script; 0 for an empty text, else 1 at least."""
    counts = [(count_of(text, pattern), ratio) for pattern, ratio in SCRIPTS.values()]
    other = F.length(text) - reduce(lambda a, b: a + b, [c for c, _ in counts])
    total = reduce(lambda a, b: a + b, [c / F.lit(r) for c, r in counts]) + other / F.lit(4.0)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(total))).cast("long")


def quarter_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def bpe_tokens(text: Column) -> Column:
    """1.3 tokens to a word or punctuation mark, 1 at least unless the text is empty."""
    n = count_of(text, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.3)))).cast("long")


def token_cost(text: Column) -> Column:
    quarter = F.greatest(F.lit(1), quarter_tokens(text))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(quarter * F.lit(0.4) + bpe_tokens(text) * F.lit(0.6)))).cast("long")


def truncated(text: Column, tokens: int) -> Column:
    return F.when(F.length(text) <= 4 * tokens, text).otherwise(F.concat(F.substring(text, 1, 4 * tokens), F.lit("...")))


# ---- splits and summaries


def claims(text: Column) -> Column:
    """Sentences, lines and clauses behind a semicolon, without bullets, of ten characters or more."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+|\n|(?<=;)\s+")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"[;.]+$", ""), r"^[-*•]\s*", "")))
    return F.filter(clean, lambda c: F.length(c) >= 10)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def two_sentences(text: Column) -> Column:
    s = sentences(text)
    return F.when(F.size(s) <= 2, text).otherwise(F.concat(F.array_join(F.slice(s, 1, 2), " "), F.lit("...")))


def summary(text: Column, most: int = 150) -> Column:
    """First one or two sentences without a leading tag or heading marks, cut at most characters."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^\[[^\n]*?\]\s*", ""), r"(?m)^#{1,6}\s+", "")
    s = F.transform(sentences(clean), lambda x: F.trim(x))
    first = F.concat(s[0], F.lit(" "))
    both = F.trim(F.when((F.size(s) < 2) | (F.length(first) >= most), first).otherwise(F.concat(first, s[1])))
    cut = (F.length(text) > F.length(both)) & ~both.endswith("...") & (F.length(both) >= most - 3)
    return F.when(F.trim(text) == "", "").otherwise(F.when(cut, F.concat(F.rtrim(F.substring(both, 1, most - 3)), F.lit("..."))).otherwise(both))


def questions(text: Column) -> Column:
    """Up to three phrases behind a Russian question word, shorter than 100 characters."""
    found = F.transform(matches(text, r"(Как|Что такое|Почему|Зачем|Где)([^.!?]+)"), lambda q: F.concat(F.trim(q), F.lit("?")))
    return F.slice(F.filter(found, lambda q: F.length(q) < 100), 1, 3)


def entities(text: Column) -> Column:
    """Capitalised runs of up to four words that are not all capitals, then version numbers; ten at most."""
    runs = matches(text, r"\b[A-ZА-Я][A-Za-zА-Яа-я0-9_\-+]{2,}(?:\s+[A-ZА-Я][A-Za-zА-Яа-я0-9_\-+]{2,}){0,3}\b")
    named = F.filter(runs, lambda r: ~r.rlike(r"^[A-ZА-Я]{2,}$"))
    return F.slice(F.array_distinct(F.concat(named, matches(text, r"\b(v?\d+\.\d+(?:\.\d+)?)\b", 1))), 1, 10)


# ---- readability and complexity


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(F.lower(word), r"e$", ""), F.lit("[aeiouy]+")))


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade over Latin words; 0 without any."""
    w = matches(text, "[A-Za-z]+")
    n = F.size(w)
    stops = F.greatest(F.lit(1), count_of(text, "[.!?]+"))
    total = F.aggregate(F.transform(w, syllables), F.lit(0), lambda a, x: a + x)
    return F.when(n == 0, 0.0).otherwise(F.lit(0.39) * (n / stops) + F.lit(11.8) * (total / n) - F.lit(15.59))


def cyrillic_grade(text: Column) -> Column:
    w = matches(text, "[А-Яа-яЁё]+")
    n = F.size(w)
    stops = F.greatest(F.lit(1), count_of(text, "[.!?]+"))
    total = F.aggregate(F.transform(w, lambda x: F.greatest(F.lit(1), F.regexp_count(F.lower(x), F.lit("[аеёиоуыэюя]+")))), F.lit(0), lambda a, x: a + x)
    return F.when(n == 0, 0.0).otherwise(F.lit(0.39) * (n / stops) + F.lit(11.8) * (total / n) - F.lit(15.59))


#: Phrases that make a query more, or less, complex. Those with pattern
#: characters are compared as plain text, as they stand.
COMPLEX = {
    "compare": 3, "contrast": 3, "differences between": 3, "vs": 2, "versus": 2, "pros and cons": 3,
    "advantages and disadvantages": 3, "step by step": 2, "explain the relationship": 3, "how does .* affect": 2,
    "what would happen if": 2, "first .* then .* finally": 2, "trade-?off": 2, "alternative": 1, "analyze": 2,
    "evaluate": 2, "benchmark": 2, "сравн": 3, "отлич": 3, "различи": 3, "против": 2, "плюсы и минусы": 3,
    "преимущества и недостатки": 3, "шаг за шагом": 2, "пошагово": 2, "как .* влияет": 2, "что будет если": 2,
    "альтернатив": 1, "анализ": 2, "оцен": 2,
}
SIMPLE = {
    "what is": 2, "what are": 2, "how to": 1, "how do": 1, "how can": 1, "where is": 1, "when is": 1, "define": 2,
    "meaning of": 2, "list of": 1, "give me": 1, "show me": 1, "find": 1, "что такое": 2, "что это": 2,
    "как сделать": 1, "как настроить": 1, "как получить": 1, "где находится": 1, "определение": 2, "значение": 2,
    "список": 1, "покажи": 1, "найди": 1,
}


def banded(n: Column, bands: list[tuple[int, int]], rest: int) -> Column:
    out = F.lit(rest)
    for most, value in reversed(bands):
        out = F.when(n <= most, value).otherwise(out)
    return out


def complexity(query: Column) -> Column:
    """1 to 10 from words, phrases, question marks and reading grade."""
    text = F.trim(query)
    low = F.lower(text)
    n = F.size(pieces(text))
    score = banded(n, [(2, 1), (5, 3), (10, 5), (18, 7)], 9)
    for table, sign in ((COMPLEX, 1), (SIMPLE, -1)):
        for phrase, weight in table.items():
            score = score + F.when(low.contains(phrase), sign * weight).otherwise(0)
    marks = count_of(low, r"\?")
    score = score + F.when(marks > 1, 2).when((marks == 1) & (n > 8), 1).otherwise(0)
    grade = F.when(text.rlike("[А-Яа-яЁё]"), cyrillic_grade(text)).otherwise(reading_grade(text))
    score = score + F.when(grade > 12, 2).when(grade > 8, 1).otherwise(0)
    return F.when(text == "", 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), score)))


#: Substrings that mark a comparison.
COMPARISONS = ["сравн", "compar", "difference", "versus", "vs", "лучше", "better", "отличие", "difference", "плюсы", "минусы", "pros", "cons", "альтернатив", "alternative"]


def plain_complexity(query: Column) -> Column:
    """The older 1 to 10 score: words, comparisons (three at most) and question marks."""
    low = F.lower(query)
    n = F.size(pieces(query))
    found = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in COMPARISONS])
    marks = count_of(query, r"\?")
    score = banded(n, [(3, 1), (6, 3), (12, 5), (20, 7)], 9) + F.least(found, F.lit(3)) + ((marks > 1) | ((marks == 1) & (n > 10))).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(10), score))


#: Results to fetch by complexity.
TOP_K = {1: 5, 2: 5, 3: 10, 4: 10, 5: 15, 6: 20, 7: 25, 8: 35, 9: 40, 10: 50}


def top_k_of(score: Column, most: int = 50) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TOP_K.items() for x in pair])
    return F.coalesce(F.element_at(table, score), F.lit(most))


# ---- masks and detectors


def masked_pii(text: Column) -> Column:
    """E-mail addresses, then IPv4 addresses, then tokens of 32 characters or more."""
    text = F.regexp_replace(text, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]")
    text = F.regexp_replace(text, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]")
    return F.regexp_replace(text, r"\b[A-Za-z0-9_-]{32,}\b", "[REDACTED]")


def masked_tokens(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    text = F.regexp_replace(text, r"\b[A-Za-z0-9]{40,}\b", "[REDACTED_TOKEN]")
    for secret in secrets:
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return text


def clean_query(text: Column, most: int = 8000) -> Column:
    text = F.regexp_replace(F.substring(text, 1, most), "<[^>]*>", "")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Injection patterns, in the order of their numbers.
SQLI = [
    r"(?i)(\bUNION\b.*\bSELECT\b)", r"(?i)(\bSELECT\b.*\bFROM\b)", r"(?i)(\bINSERT\b\s+\bINTO\b)",
    r"(?i)(\bUPDATE\b\s+\w+\s+\bSET\b)", r"(?i)(\bDELETE\b\s+\bFROM\b)", r"(?i)(\bDROP\b\s+\bTABLE\b)",
    r"(?i)(\bALTER\b\s+\bTABLE\b)", r"(?i)(\bEXEC\b\s*[\(x])", r"""(?i)(\bOR\b\s+['"]?\d?['"]?\s*=\s*['"]?\d?['"]?)""",
    r"""(?i)(\bAND\b\s+['"]?\d?['"]?\s*=\s*['"]?\d?['"]?)""", r"(?i)(\bSLEEP\b\s*\()", r"(?i)(\bBENCHMARK\b\s*\()",
    r"(?i)(\bWAITFOR\b\s+\bDELAY\b)", r"(?i)(\/\*.*\*\/)", r"(--\s*[^\n]*$)",
    r"(;\s*\bDROP\b|\bSELECT\b|\bUPDATE\b|\bDELETE\b)",
]
XSS = [
    r"(?is)<script[^>]*>.*?</script>", r"(?i)javascript\s*:", r"""(?i)on\w+\s*=\s*["'][^"']*["']""", r"(?i)<iframe[^>]*>",
    r"(?i)<embed[^>]*>", r"(?i)<object[^>]*>", r"(?i)data\s*:\s*text/html", r"(?i)vbscript\s*:", r"(?i)expression\s*\(",
]


def detected(text: Column, patterns: list[str], name: str) -> Column:
    """Names, by number, of the patterns found."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(f"{name}_pattern_{i}")) for i, p in enumerate(patterns)]))


def issue_keys(text: Column) -> Column:
    return matches(text, r"\b[A-Z][A-Z0-9]+-\d+\b")


def urls(text: Column) -> Column:
    return matches(text, r"""https?://[^\s<>"']+""")


# ---- quality

#: Boilerplate patterns, compared without case.
BOILERPLATE = [
    r"(last\s*modified|последнее\s*изменение|изменено)", r"(all rights reserved|все права защищены)",
    r"(copyright|авторские права)\s*[©™℠]", r"(powered by|работает на|создано с помощью)",
    r"(terms of (use|service)|условия использования)", r"(privacy policy|политика конфиденциальности)",
    r"(cookie|куки)\s+(notice|policy|уведомление)", r"^(home|главная)\s*[>»/]\s*",
    r"(breadcrumbs?|навигация|хлебные крошки)", r"^(previous|next|prev|следующая|предыдущая)\s*(page|страница)?",
    r"(footer|подвал|нижний колонтитул)", r"^\s*(©|\(c\))\s*\d{4}", r"(subscribe|unsubscribe|подписаться|отписаться)",
    r"(follow us|следите за нами|мы в соцсетях)", r"(facebook|twitter|instagram|linkedin|telegram|vkontakte|одноклассники)",
    r"^(comments?|discussions?|комментарии|обсуждения)\s*[:;]*\s*$",
    r"^(leave a|оставить)\s+(comment|reply|ответ|комментарий)",
]
MINIMAL = [r"^\s*$", r"^\s*[-–—]{3,}\s*$", r"^\s*[*•·▪▸►]\s*$"]


#: What a text, lower-cased, must contain, or begin with, to match any of BOILERPLATE.
INSIDE = [
    "modified", "последнее", "изменено", "all rights reserved", "все права защищены", "copyright", "авторские права",
    "powered by", "работает на", "создано с помощью", "terms of", "условия использования", "privacy policy",
    "политика конфиденциальности", "cookie", "куки", "breadcrumb", "навигация", "хлебные крошки", "footer", "подвал",
    "нижний колонтитул", "subscribe", "подписаться", "отписаться", "follow us", "следите за нами", "мы в соцсетях",
    "facebook", "twitter", "instagram", "linkedin", "telegram", "vkontakte", "одноклассники",
]
BEGINNINGS = ["home", "главная", "prev", "next", "следующая", "предыдущая", "©", "(c)", "comment", "discussion", "комментарии", "обсуждения", "leave a", "оставить"]
#: The letter that lower-casing leaves but a comparison without case takes for an s.
LONG_S = "ſ"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def boilerplate_reason(text: Column, least_chars: int = 20, least_words: int = 3) -> Column:
    """Why a text is boilerplate, the first reason that holds; empty: it is not.

    The text is trimmed and lower-cased once; patterns are tried only where a
    word that they need is there.
    """

    def patterns(own: Column) -> Column:
        reason = F.when(own.rlike("(?iu)" + BOILERPLATE[0]), F.lit(f"boilerplate_pattern_{BOILERPLATE[0][:40]}"))
        for p in BOILERPLATE[1:]:
            reason = reason.when(own.rlike("(?iu)" + p), F.lit(f"boilerplate_pattern_{p[:40]}"))
        return reason.otherwise("")

    def possible(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(w) for w in INSIDE] + [low.startswith(w) for w in BEGINNINGS] + [low.contains(LONG_S)])

    def decided(own: Column) -> Column:
        n = F.size(pieces(own))
        reason = F.when(reduce(lambda a, b: a | b, [own.rlike(p) for p in MINIMAL]), "minimal_or_empty_content")
        reason = reason.when(F.length(own) < least_chars, F.concat(F.lit("too_short_"), F.length(own), F.lit("_chars")))
        reason = reason.when(~own.rlike(r"^\S+(?:\s+\S+){%d}" % (least_words - 1)), F.concat(F.lit("too_few_words_"), n))
        return reason.when(once(F.lower(own), possible), patterns(own)).otherwise("")

    return once(F.regexp_replace(text, r"^\s+|\s+$", ""), decided)


def coherence(text: Column, titled: Column | None = None, summarised: Column | None = None) -> Column:
    """0 to 1 from word bands, type-token ratio, title and summary."""
    w = pieces(text)
    n = F.size(w)
    ratio = F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x)))) / n
    score = F.lit(0.5) + F.when(n.between(50, 800), 0.2).otherwise(0.0) + F.when(ratio > 0.6, 0.15).when(ratio > 0.3, 0.1).otherwise(0.0)
    for flag, weight in ((titled, 0.1), (summarised, 0.05)):
        if flag is not None:
            score = score + F.when(flag, weight).otherwise(0.0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(n < 5, n / 5 * F.lit(0.1)).when(n > 2000, 0.5).otherwise(F.least(F.lit(1.0), score))


# ---- overlap of word sets

#: Words that overlap metrics leave out.
METRIC_STOP = [
    "what", "is", "the", "a", "an", "how", "why", "when", "where", "who", "which", "do", "does", "can", "could", "should",
    "would", "will", "of", "to", "in", "for", "on", "with", "at", "by", "from", "it", "its", "be", "are", "was", "were",
    "been", "being", "have", "has", "had", "this", "that", "these", "those", "and", "or", "but", "not", "no",
]


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """Share of set a found in set b; 0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(overlap(a, b) / F.size(a))


def set_cosine(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap(a, b) / F.sqrt(F.size(a).cast("double") * F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(overlap(a, b) / either)


def support(claim: Column, context: Column) -> Column:
    """Half cosine, half containment of a claim's words in a context's; 0 where either has none. The overlap is counted once."""
    none = (F.size(claim) == 0) | (F.size(context) == 0)
    shared = lambda k: k / F.sqrt(F.size(claim).cast("double") * F.size(context)) * 0.5 + k / F.size(claim) * 0.5
    return F.when(none, 0.0).otherwise(once(overlap(context, claim), shared))


# ---- queries and versions


def query_version(text: Column) -> Column:
    """A version number, or a date, that a query names; null: none."""
    tries = [
        F.regexp_extract(text, r"(?i)(?:v|version)[\s]*(\d+(?:\.\d+)+(?:\.\d+)?)", 1),
        F.regexp_extract(text, r"(?i)version[\s]*[=:][\s]*(\d+(?:\.\d+)+)", 1),
        F.regexp_extract(text, r"(?i)версия[\s]*(\d+(?:\.\d+)+)", 1),
        F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1),
    ]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries])


def version_key(version: Column) -> Column:
    """Numbers of a version, for ordering; [0] of a null one."""
    parts = F.filter(F.split(F.coalesce(version, F.lit("0")), "[.-]"), lambda p: p.rlike(r"^\d+$"))
    return F.transform(parts, lambda p: p.cast("int"))


def header(**parts: Column) -> Column:
    """[Type: ...] [Doc: ...] for each part that is there."""
    shown = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"[{k}: "), v, F.lit("]"))) for k, v in parts.items()]
    return F.concat_ws(" ", *shown)


# ---- language

#: Letters and common words that tell German and French from other languages.
GERMAN_LETTERS = "äöüßÄÖÜ"
FRENCH_LETTERS = "àâäæçèéêëîïôœùûüÿÀÂÄÆÇÈÉÊËÎÏÔŒÙÛÜŸ"
GERMAN_WORDS = [
    "und", "ein", "eine", "der", "die", "das", "ist", "nicht", "mit", "von", "für", "auf", "ich", "wir", "sie", "was",
    "wie", "wo", "sind", "aus", "wird", "werden", "wurde", "wenn", "auch", "noch", "schon", "diese", "durch", "über",
    "nach", "vor", "bei", "ab", "seit", "dass", "oder", "aber", "sich", "einen", "dem", "den", "des", "im", "am",
    "um", "zum", "zur", "kein", "keine", "mehr", "als", "nur",
]
FRENCH_WORDS = [
    "est", "vous", "dans", "avec", "pour", "sur", "comment", "quelle", "sont", "nous", "ils", "elles", "leur",
    "leurs", "comme", "cette", "aussi", "tout", "tous", "toute", "toutes", "faire", "peut", "être", "avoir", "entre",
    "deux", "même", "autre", "autres", "sans", "mais", "donc", "encore", "toujours", "ainsi", "alors", "peuvent",
    "doit", "doivent", "depuis", "rendre", "pendant", "avant", "après", "celui", "celle", "ceux", "celles",
    "certains", "certaines", "votre", "notre", "sera", "seront", "étaient", "était", "moins", "plus", "très", "bien",
    "dire", "mettre", "nouveau", "nouvelle", "nouveaux", "premier", "première",
]


def language(text: Column) -> Column:
    """zh, ru, de, fr or en, from scripts, letters and common words; en for an empty or null text."""
    n = lambda letters: F.coalesce(count_of(text, f"[{letters}]"), F.lit(0))
    alpha = n(r"\p{L}")
    cjk, cyrillic = n(r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"), n("А-яЁё")
    common = lambda own, table: 3 * F.size(F.array_intersect(own, F.array(*map(F.lit, table))))
    words_ = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    letters = F.struct(n(GERMAN_LETTERS).alias("de"), n(FRENCH_LETTERS).alias("fr"))
    scores = lambda x, own: F.struct(x["de"].alias("de"), x["fr"].alias("fr"), (x["de"] + common(own, GERMAN_WORDS)).alias("de_score"), (x["fr"] + common(own, FRENCH_WORDS)).alias("fr_score"))
    latin = lambda s: (
        F.when((s["de_score"] >= 2) & (s["de_score"] > s["fr_score"]), "de")
        .when((s["fr_score"] >= 2) & (s["fr_score"] > s["de_score"]), "fr")
        .when((s["de"] > 0) & (s["de"] >= alpha * F.lit(0.03)), "de")
        .when((s["fr"] > 0) & (s["fr"] >= alpha * F.lit(0.03)), "fr")
        .otherwise("en")
    )
    by_words = once(words_, lambda own: once(letters, lambda x: once(scores(x, own), latin)))
    script = lambda count, name, other: once(count, lambda k: F.when((k > 0) & (k >= alpha * F.lit(0.1)), F.lit(name)).otherwise(other))
    return script(cjk, "zh", script(cyrillic, "ru", by_words))


#: Substrings that mark an intent, by language.
GREETINGS = {"de": ["hallo", "guten tag", "guten morgen", "guten abend", "hi", "hey", "moin", "servus", "grüß"], "fr": ["bonjour", "bonsoir", "salut", "coucou", "hello", "hi"], "zh": ["你好", "您好", "嗨", "哈喽"]}
HOW_TO = {"de": ["wie", "anleitung", "konfigurieren", "einrichten", "erstellen", "installieren"], "fr": ["comment", "configurer", "installer", "créer", "mettre en place", "guide"], "zh": ["如何", "怎么", "怎样", "如何做", "攻略", "教程"]}
COMPARE = {"de": ["vergleich", "unterschied", "besser", "schlechter", "vs", "oder"], "fr": ["comparaison", "différence", "mieux", "moins bien", "vs", "ou"], "zh": ["对比", "区别", "哪个更好", "比较", "差异"]}


def intent(text: Column, lang: Column) -> Column:
    """greeting, comparison, procedural or factual for German, French and Chinese; null for others, whose intent a model gives."""
    low = F.lower(text)
    has = lambda table: reduce(lambda a, b: a | b, [(lang == code) & low.contains(w) for code, ws in table.items() for w in ws])
    return F.when(lang.isin("de", "fr", "zh"), F.when(has(GREETINGS), "greeting").when(has(COMPARE), "comparison").when(has(HOW_TO), "procedural").otherwise("factual"))


#: Words that say one thing is related to another.
RELATIONS = ["связан", "зависит", "использует", "относится", "принадлежит", "содержит"]


def wants_graph(text: Column, intent_: Column) -> Column:
    return F.coalesce(intent_ == "comparison", F.lit(False)) | reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in RELATIONS])


#: Questions about a graph, and the statements that answer them.
GRAPH_QUESTIONS = [
    (r"what (?:projects?|repos?|repositories?) (?:does|do) (\w+) work on", "MATCH (p:Person {name: '{entity}'})-[:WORKS_ON]->(proj:Project) RETURN proj.name, proj.description"),
    (r"who (?:works?|worked?) on (\w+)", "MATCH (p:Person)-[:WORKS_ON]->(proj:Project {name: '{entity}'}) RETURN p.name, p.role"),
    (r"what (?:issues?|tickets?|tasks?) (?:are|is) (?:related|linked) to (\w+)", "MATCH (i:Issue)-[:RELATED_TO]->(e {name: '{entity}'}) RETURN i.key, i.summary, i.status"),
    (r"what (?:dependencies|depends) (?:does|do) (\w+) (?:have|has)", "MATCH (e {name: '{entity}'})-[:DEPENDS_ON]->(dep) RETURN dep.name, dep.type"),
]
NO_ENTITY = ["What", "How", "When", "Where", "Who", "Which", "The", "This", "That"]
ANY_NODE = "MATCH (n) WHERE n.name CONTAINS '{entity}' OR n.description CONTAINS '{entity}' RETURN n.name, n.description, labels(n) LIMIT 10"


def graph_statement(question: Column) -> Column:
    """The statement for the first pattern that a question fits, else for its first capitalised word; null: neither.

    The recorded two-entity pattern has a template whose names are never filled,
    so it is left out.
    """
    low = F.lower(F.trim(question))
    fill = lambda template, name: F.replace(F.lit(template), F.lit("{entity}"), name)
    out = None
    for pattern, template in GRAPH_QUESTIONS:
        name = F.regexp_extract(low, pattern, 1)
        made = fill(template, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20)))
        out = F.when(low.rlike(pattern), made) if out is None else out.when(low.rlike(pattern), made)
    named = F.filter(pieces(question), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 2) & ~w.isin(NO_ENTITY))
    return out.when(F.size(named) > 0, fill(ANY_NODE, F.get(named, F.lit(0))))


# ---- markup


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, four entities read, blank lines left out."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(t, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_headings(html: Column) -> Column:
    """array<struct<level, text>> of h1 to h3."""
    found = matches(html, r"(?is)<h[1-3][^>]*>.*?</h[1-3]>")
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(h, "(?s)<[^>]*>", "")).alias("text")))


def html_links(html: Column) -> Column:
    return matches(html, 'href="([^"]+)"', 1)


def html_markdown(html: Column) -> Column:
    """Headings, list items, links and paragraphs as Markdown; images, scripts and styles dropped."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<img[^>]*>", "")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n\n")
    t = F.regexp_replace(t, r"(?is)<li[^>]*>(.*?)</li>", "- $1\n")
    t = F.regexp_replace(t, r"""(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>""", r"[$2]($1)")
    t = F.regexp_replace(t, r"(?is)</p>|<br\s*/?>", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", ""), r"\n{3,}", "\n\n"))


def rst_text(text: Column) -> Column:
    """reStructuredText without directives, roles, underlines and literal marks."""
    t = F.regexp_replace(text, r"(?m)^\.\. .*$", "")
    t = F.regexp_replace(t, r":[a-z]+:`([^`]*)`", "$1")
    t = F.regexp_replace(t, r"(?m)^[=\-~^\"'*+#]{3,}\s*$", "")
    return F.trim(F.regexp_replace(t, "``?([^`]*)``?", "$1"))


def asciidoc_text(text: Column) -> Column:
    """AsciiDoc without attributes, block marks and heading marks."""
    t = F.regexp_replace(text, r"(?m)^:[^:]+:.*$", "")
    t = F.regexp_replace(t, r"(?m)^(----|====|\.\.\.\.)\s*$", "")
    return F.trim(F.regexp_replace(t, r"(?m)^=+\s+", ""))


# ---- time

#: Days that a source stays fresh.
FRESH_DAYS = {"confluence": 90, "jira": 30, "gitlab": 14, "file": 365, "book": 365, "chat": 90}
FRESH_DEFAULT = 180


def age_days(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86400e6))


def decayed(score: Column, ts: Column, as_of: Column, days: float = 180.0) -> Column:
    """score * (1 + exp(-age / days)); unchanged without a time."""
    return F.coalesce(score * (1 + F.exp(-age_days(ts, as_of) / F.lit(days))), score)


def staleness(ts: Column, as_of: Column, source_type: Column) -> Column:
    """0 (fresh) to 100: age over the source's days; 50 without a time."""
    days = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FRESH_DAYS.items() for x in kv]), source_type), F.lit(FRESH_DEFAULT))
    return F.coalesce(F.least(F.lit(100.0), age_days(ts, as_of) / days * 100), F.lit(50.0))


def expanded(query: Column, most: int = 3) -> Column:
    """A query and up to most variants of it, by its first word or its keywords (words of more than three characters), each once."""
    words = filter_words(query)
    low = F.lower(query)
    rest = lambda n: F.regexp_replace(F.substring(query, n, 1 << 30), r"^\s+|\s+$", "")
    both = lambda a, b, n: F.array(query, F.concat(F.lit(a), rest(n)), F.concat(F.lit(b), rest(n)))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    at = F.locate(" vs ", query)
    left, right = trimmed(F.substring(query, F.lit(1), at - 1)), trimmed(F.substring(query, at + 4, F.length(query)))
    sides = lambda a: F.concat(F.lit(a), left, F.lit(" and "), right)
    made = (
        F.when(low.startswith("how") & (F.size(words) > 1), both("steps to ", "guide for ", 5))
        .when(low.startswith("what"), both("definition of ", "explain ", 6))
        .when(low.startswith("why"), both("reason for ", "cause of ", 5))
        .when(at > 0, F.array(query, sides("difference between "), sides("comparison of ")))
        .when(F.size(words) >= 2, F.array(query, F.array_join(words, " "), F.concat(words[0], F.lit(" related to "), F.try_element_at(words, F.lit(2)))))
        .otherwise(F.array(query))
    )
    return F.slice(F.array_distinct(made), 1, most + 1)


def filter_words(query: Column) -> Column:
    return F.filter(pieces(query), lambda w: F.length(w) > 3)


#: Beginnings of questions in Russian and in English, in the order in which they are looked for.
ASKING_RU = ["[Кк]ак", "[Чч]то такое", "[Пп]очему", "[Гг]де", "[Зз]ачем", "[Кк]огда", "[Кк]то"]
ASKING_EN = ["[Hh]ow", "[Ww]hat", "[Ww]hy", "[Ww]here", "[Ww]hen", "[Ww]ho", "[Cc]an"]


def mined_questions(text: Column, title: Column, section: Column, source_type: Column) -> Column:
    """Up to three questions that a text answers.

    Phrases behind Russian question words, or if there is none, English
    questions, of 11 to 199 characters; else what title, section and kind of
    source suggest; else one about the first sentence. Nulls read as empty.
    """
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    read = F.coalesce(text, F.lit(""))
    phrases = lambda words, end: F.filter(F.transform(F.flatten(F.array(*[matches(read, rf"({w}\s[^.!?]+{end})") for w in words])), trim), lambda q: (F.length(q) > 10) & (F.length(q) < 200))
    name, part, kind = (F.coalesce(x, F.lit("")) for x in (title, section, source_type))
    about = F.concat(F.when(name != "", F.array(F.concat(F.lit("Что такое "), name, F.lit("?")))).otherwise(F.array()), F.when((part != "") & (part != name), F.array(F.concat(F.lit("Как работает "), part, F.lit("?")))).otherwise(F.array()))
    general = F.when(kind == "jira", "Как решить эту задачу?").when(kind == "confluence", "О чём этот документ?")
    told = once(about, lambda a: F.concat(a, F.when(general.isNotNull(), F.array(general)).when((kind != "") & (F.size(a) < 2), F.array(F.lit("Что содержится в этом документе?"))).otherwise(F.array())))
    last = F.array(F.concat(F.lit("Что такое "), F.substring(trim(sentences(read)[0]), 1, 100), F.lit("?")))
    pick = lambda first, rest: once(first, lambda x: F.when(F.size(x) > 0, x).otherwise(rest))
    return F.slice(pick(phrases(ASKING_RU, "[.!?]"), pick(phrases(ASKING_EN, r"\?"), pick(told, last))), 1, 3)


def json_text(value: Column) -> Column:
    """A string as JSON writes it, null as an empty one."""
    held = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("x")))
    return held.substr(F.lit(6), F.length(held) - 6)


def chunk_hash(fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """SHA-256 of a chunk's fields as JSON with sorted keys; the values of lists are sorted, so their order is no change."""
    strings = {k: json_text(v) for k, v in fields.items()}
    arrays = {k: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.coalesce(v, F.array().cast("array<string>"))), json_text), ", "), F.lit("]")) for k, v in lists.items()}
    parts = [x for k, v in sorted((strings | arrays).items()) for x in (F.lit(f'"{k}": '), v, F.lit(", "))][:-1]
    return F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256)
