"""Column functions on text: sentences, inline maths, labels, tags, HTML."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
ABBREVIATIONS = (
    "e.g.", "i.e.", "etc.", "cf.", "vs.", "fig.", "figs.", "eq.", "eqs.", "sec.", "secs.", "no.", "nos.",
    "dr.", "mr.", "mrs.", "ms.", "prof.", "pp.", "vol.", "ed.", "eds.", "approx.",
)
GREEK = {
    "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Υ": "Upsilon", "Φ": "Phi",
    "Ψ": "Psi", "Ω": "Omega", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "varepsilon", "ζ": "zeta", "η": "eta",
    "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho",
    "ς": "varsigma", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "varphi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
MATH = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"
CUT = "\x01"
# Patterns are put together from these; (?U) makes \s and \d know all of Unicode's
# blanks and digits, as PDF texts and Japanese have them.
SPAN = r"\$[^$\n]+\$"
STOP, CLOSER, OPENER = "[.!?]+", "[\"'”)\\]]*", "[A-Z0-9\"“(]"
NUMBER = "[A-Z0-9]+(?:[.][0-9]+)*"
LABEL = r"(?iU)^(figure|fig|table)[.]?\s*(\d+)\s*[.:]"
GREEK_LETTER = "Α-Ωα-ω"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """White space off both ends (all of Unicode's, unlike trim)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def split_sentences(text: Column) -> Column:
    """Array of sentences. A boundary stands after a run of . ! ? and any
    closing quotes or brackets, before white space and an ASCII capital, digit,
    opening quote or bracket; not after a known abbreviation or an initial."""
    marked = F.regexp_replace(text, rf"(?U)({STOP}{CLOSER})(\s+)(?={OPENER})", f"$1{CUT}$2")
    words = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS)
    # the last token, less leading characters that are no ASCII letters or digits, decides
    kept = F.regexp_replace(marked, rf"(?U)((?:^|\s|{CUT})[^\sA-Za-z0-9{CUT}]*(?:(?i:{words})|[A-Z][.])){CUT}", "$1")
    return F.filter(F.transform(F.split(kept, CUT), strip), lambda s: s != "")


def outside_math(text: Column, change) -> Column:
    """change applied to the stretches of text outside $...$."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\$[^$]*\$|[^$]+|\$"), F.lit(0))
    return F.array_join(F.transform(parts, lambda s: F.when(s.startswith("$"), s).otherwise(change(s))), "")


def wrap_letter_equals(text: Column) -> Column:
    put = lambda s: F.regexp_replace(s, r"(?U)\b([a-zA-Z]\s*=\s*[a-zA-Z0-9]+)\b", r"\$$1\$")
    return let(text, lambda t: F.when(t.contains("="), outside_math(t, put)).otherwise(t))


def replace_words(text: Column, fixes: Column) -> Column:
    """Words (runs of word characters) outside maths that are keys of the map
    fixes as their values."""
    words = lambda s: F.regexp_extract_all(s, F.lit(r"(?Us)\w+|\W+"), F.lit(0))
    return outside_math(text, lambda s: F.array_join(F.transform(words(s), lambda w: F.coalesce(F.try_element_at(fixes, w), w)), ""))


def wrap_greek(text: Column) -> Column:
    """Runs of Greek letters as $...$ of TeX commands; capitals that look Latin
    have none and stay. Texts without Greek are passed on untouched."""
    names = F.create_map(*[F.lit(x) for letter, name in GREEK.items() for x in (letter, "\\" + name)])
    tex = lambda run: F.array_join(F.transform(F.split(run, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")

    def wrap(s):
        runs = F.regexp_extract_all(s, F.lit(f"(?s)[{GREEK_LETTER}]+|[^{GREEK_LETTER}]+"), F.lit(0))
        return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{GREEK_LETTER}]"), F.concat(F.lit("$"), tex(r), F.lit("$"))).otherwise(r)), "")

    return let(text, lambda t: F.when(t.rlike(f"[{GREEK_LETTER}]"), outside_math(t, wrap)).otherwise(t))


def normalise(text: Column) -> Column:
    """What every text passes before it is cut into sentences; merged compounds
    come after it, as they need a lexicon (operators.layout.normalise_items)."""
    return wrap_greek(wrap_letter_equals(text))


def math_spans(text: Column) -> Column:
    """The maths spans in order, with <, > for TeX's names of them."""
    spans = F.regexp_extract_all(text, F.lit(MATH), F.lit(0))
    return F.transform(spans, lambda s: F.replace(F.replace(s, F.lit("\\textless"), F.lit("<")), F.lit("\\textgreater"), F.lit(">")))


def protect(text: Column) -> Column:
    """text with its maths spans as __MATH0__, __MATH1__, ..."""
    plain = F.split(F.regexp_replace(text, MATH, CUT), CUT)
    return F.concat_ws("", F.transform(plain, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit("__MATH"), (i - 1).cast("string"), F.lit("__"), s))))


def restore(text: Column, spans: Column) -> Column:
    """Placeholders as their spans again, in one pass; unknown ones stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)__MATH\d+__|.+?(?=__MATH\d+__|\z)"), F.lit(0))
    at = lambda s: F.regexp_extract(s, r"^__MATH(\d+)__\z", 1)
    return F.array_join(F.transform(parts, lambda s: F.when(at(s) != "", F.coalesce(F.get(spans, at(s).try_cast("int")), s)).otherwise(s)), "")


def normalize_math(text: Column) -> Column:
    return restore(protect(text), math_spans(text))


_NUMBERED = rf"(?U)^({NUMBER})[.]\s+[^\s][^\n]*\z"


def heading_number(text: Column) -> Column:
    """'2.1' of '2.1. Preliminaries'; empty if text is no numbered heading."""
    return F.regexp_extract(text, _NUMBERED, 1)


def heading_name(text: Column) -> Column:
    """What stands after the number; empty if text is no numbered heading."""
    return F.when(text.rlike(_NUMBERED), F.regexp_replace(text, rf"(?U)^{NUMBER}[.]\s+", "")).otherwise("")


def slugify(name: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, "^[A-Za-z]+", 0)), F.lit("")), F.lit("section"))


def caption_kind(text: Column) -> Column:
    kind = F.lower(F.regexp_extract(text, LABEL, 1))
    return F.when(kind == "table", "table").when(kind != "", "figure")


def caption_number(text: Column) -> Column:
    return F.regexp_extract(text, LABEL, 2).try_cast("int")


def equation_number(latex: Column) -> Column:
    return F.regexp_extract(latex, r"\\tag\{(\d+)\}", 1).try_cast("int")


def strip_fences(latex: Column) -> Column:
    return strip(F.regexp_replace(latex, r"^\$\$|\$\$\z", ""))


def classify_tag(tag: Column) -> Column:
    return (
        F.when(tag.rlike(r"-LATEX\z"), "equation_latex").when(tag.rlike(r"^P\d+-TITLE\z"), "title").when(tag.rlike(r"^P\d+-AUTHORS\z"), "authors")
        .when(tag.rlike(r"^P\d+-AFFIL\z"), "affil").when(tag.rlike(r"^P\d+-HEADING-"), "heading").when(tag.rlike(r"^P\d+-UNKNOWN-"), "unknown")
        .when(tag.rlike(r"-CAPTION-S\d+\z"), "caption_sentence").when(tag.rlike(r"^P\d+-S\d+-"), "body_sentence").otherwise("unknown")
    )


def section_slug(tag: Column) -> Column:
    """The section of a heading's or sentence's tag; empty for others."""
    head = F.regexp_extract(tag, r"^P\d+-HEADING-(.*)\z", 1)
    return F.when(head != "", head).otherwise(F.regexp_extract(tag, r"^P\d+-S\d+-(.*)-S\d+\z", 1))


def in_references(slug: Column) -> Column:
    return slug.rlike(r"(?i)(^|\.)references\z")


def heading_level(section: Column) -> Column:
    """2 to 4, by the leading numeric parts of a section's id."""
    parts = F.size(F.regexp_extract_all(F.regexp_extract(section, r"^(?:\d+\.)*", 0), F.lit(r"\d+"), F.lit(0)))
    return F.least(F.lit(4), 2 + F.greatest(parts - 1, F.lit(0)))


def paragraph_key(tag: Column) -> Column:
    body = F.regexp_extract(tag, r"^(P\d+)-S\d+-.*-S\d+\z", 1)
    return F.when(tag.rlike(r"-CAPTION-S\d+\z"), F.regexp_replace(tag, r"-S\d+\z", "")).when(body != "", F.concat_ws("-", body, section_slug(tag))).otherwise(tag)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def leak_candidates(text: Column) -> Column:
    """Half-width or Greek stretches left outside maths: with a letter, and of
    four characters at most or with one of ()=_^{}."""
    runs = F.regexp_extract_all(F.regexp_replace(text, MATH, ""), F.lit(f"[ -~{GREEK_LETTER}]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda t: F.trim(t)), lambda t: t.rlike(f"[A-Za-z{GREEK_LETTER}]") & ((F.length(t) <= 4) | t.rlike(r"[()=_^{}]")))


def strip_unpaired(token: Column) -> Column:
    left = F.when(token.startswith("(") & ~token.contains(")"), F.substring(token, 2, 1 << 30)).otherwise(token)
    return F.when(token.endswith(")") & ~token.contains("("), F.regexp_replace(left, r"\)\z", "")).otherwise(left)


_ARGUMENT = r"[\s0-9A-Za-z,.’'_|+-]"
_CALL = rf"(?U)(?<![0-9A-Za-z_])[A-Za-z]{{1,4}}\((?:{SPAN}|{_ARGUMENT})+?\)"
_COMPARE = rf"(?U){SPAN}\s*(?:[<>=!]=|[<>≤≥≠])\s*(?:-?\d+(?:[.]\d+)?|{SPAN})"


def function_calls(text: Column) -> Column:
    """Replacements of calls with maths arguments: array of (old, new)."""
    calls = F.filter(F.regexp_extract_all(text, F.lit(_CALL), F.lit(0)), lambda s: s.contains("$"))
    return F.transform(calls, lambda s: F.struct(s.alias("old"), F.concat(F.lit("$"), F.replace(s, F.lit("$"), F.lit("")), F.lit("$")).alias("new")))


def comparisons(text: Column) -> Column:
    """Replacements of $a$ > 1 by $a > 1$: array of (old, new)."""
    found = F.regexp_extract_all(text, F.lit(_COMPARE), F.lit(0))
    return F.transform(found, lambda s: F.struct(s.alias("old"), F.concat(F.lit("$"), F.replace(s, F.lit("$"), F.lit("")), F.lit("$")).alias("new")))


def replace_first(text: Column, changes: Column) -> Column:
    """Each (old, new) in turn at the first place of old, taken literally."""

    def one(t, c):
        at = F.instr(t, c["old"]) if isinstance(c, str) else F.call_function("locate", c["old"], t)
        return F.when(at > 0, F.overlay(t, c["new"], at, F.length(c["old"]))).otherwise(t)

    return F.aggregate(changes, text, one)
