"""From units to translated, repaired units. Order within a document is (ord, pos);
every row keeps all it needs, so nothing is joined and one shuffle by document
serves all windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types

from ..functions import text as T

TRANSLATABLE = ("title", "heading", "body_sentence", "caption_sentence")


class TranslationError(RuntimeError):
    """A translator gave back too few texts, or none for a row."""


def exclude_references(units: DataFrame) -> DataFrame:
    """translatable: of the kinds that are, and outside the references; ja_text is
    en_text where it is false, else null."""
    referring = F.col("kind").isin("heading", "body_sentence") & T.in_references(T.section_slug(F.col("tag")))
    d = units.withColumn("translatable", F.coalesce(F.col("kind").isin(*TRANSLATABLE) & ~referring, F.lit(False)))
    return d.withColumn("ja_text", F.when(~F.col("translatable"), F.col("en_text")))


def only_translatable(units: DataFrame) -> DataFrame:
    return units.where("translatable")


def document_context(units: DataFrame) -> DataFrame:
    """The first title, then the abstract's sentences, per document."""
    got = units.groupBy("doc_id").agg(
        F.min_by("en_text", F.when(F.col("kind") == "title", F.struct("ord", "pos"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(_in_abstract(), F.struct("ord", "pos", "en_text")))), lambda s: s["en_text"]), " ").alias("abstract"),
    )
    return got.select("doc_id", _context(F.col("title"), F.col("abstract")).alias("context"))


def _in_abstract() -> Column:
    return (F.col("kind") == "body_sentence") & F.col("tag").contains("-abstract-")


def _context(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")))


def prepare(units: DataFrame) -> DataFrame:
    """Units ready for a translator: escapes in the maths of translatable kinds
    rewritten, references left out, protected text and math_spans, and context: the
    document's, then the (up to) three protected sentences before."""
    d = units.withColumn("en_text", F.when(F.col("kind").isin(*TRANSLATABLE), T.normalize_math(F.col("en_text"))).otherwise(F.col("en_text")))
    d = exclude_references(d)
    own = F.col("translatable")
    d = d.withColumn("protected", F.when(own, T.protect(F.col("en_text")))).withColumn("math_spans", F.when(own, T.math_spans(F.col("en_text"))))
    doc = Window.partitionBy("doc_id").orderBy("ord", "pos")
    whole = doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = F.first(F.when(F.col("kind") == "title", F.col("en_text")), True).over(whole)
    abstract = F.array_join(F.collect_list(F.when(_in_abstract(), F.col("en_text"))).over(whole), " ")
    near = F.collect_list("protected").over(Window.partitionBy("doc_id", "translatable").orderBy("ord", "pos").rowsBetween(-3, -1))
    d = d.withColumn("_title", title).withColumn("_abstract", abstract).withColumn("_near", F.nullif(F.array_join(near, "\n"), F.lit("")))
    context = F.nullif(F.concat_ws("\n\n", F.nullif(_context(F.col("_title"), F.col("_abstract")), F.lit("")), "_near"), F.lit(""))
    return d.withColumn("context", F.when(own, context)).drop("_title", "_abstract", "_near")


def translation_context(units: DataFrame) -> DataFrame:
    """prepare()'s rows that go to a translator."""
    return only_translatable(prepare(units))


Translator = Callable[[pd.DataFrame], "list[str] | pd.Series"]


def run_translator(prepared: DataFrame, translator: Translator) -> DataFrame:
    """prepare()'s rows with raw_text by translator, which gets the translatable rows
    of an Arrow batch as a frame (doc_id, ord, pos, text, context) and gives a text
    for each. Rows don't depend on each other's translations, so batches run
    anywhere; a missing text fails the job (TranslationError)."""
    schema = types.StructType([*prepared.schema.fields, types.StructField("raw_text", types.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["translatable"].to_numpy(dtype=bool)
            raw = pd.Series([None] * len(b), index=b.index, dtype=object)
            if own.any():
                asked = b.loc[own, ["doc_id", "ord", "pos", "protected", "context"]].rename(columns={"protected": "text"})
                got = list(translator(asked))
                if len(got) != len(asked) or any(not isinstance(t, str) for t in got):
                    raise TranslationError(f"{len(asked)} texts were asked for, {sum(isinstance(t, str) for t in got)} came")
                raw[own] = got
            yield b.assign(raw_text=raw)

    return prepared.mapInPandas(run, schema)


def translate(units: DataFrame, translator: Translator | None = None, backend: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All units, with ja_text. Translatable ones are translated by translator (see
    run_translator) or backend, a function of the (protected, context) columns; by
    default they come back as they are. Their maths is restored; other units keep
    en_text."""
    d = prepare(units)
    if translator:
        d = run_translator(d, translator)
    else:
        raw = backend(F.col("protected"), F.col("context")) if backend else F.col("protected")
        d = d.withColumn("raw_text", F.when(F.col("translatable"), raw))
    return d.withColumn("ja_text", F.when(F.col("translatable"), T.restore(F.col("raw_text"), F.col("math_spans"))).otherwise(F.col("en_text")))


def _flagged(units: DataFrame) -> Column:
    return F.col("translatable") if "translatable" in units.columns else F.lit(True)


def _letter_by_letter(todo: Column, en: Column, ja: Column) -> Column:
    """(en, ja, n) with each letter of todo in turn made maths: for texts with a stray
    dollar, where one letter's dollars may pair with it and so change what is maths."""

    def wrap(acc, t):
        alone = F.concat(F.lit("(?<![A-Za-z0-9])"), t, F.lit("(?![A-Za-z0-9])"))
        plain = {k: T.protect(acc[k]) for k in ("en", "ja")}
        both = F.regexp_like(plain["en"], alone) & F.regexp_like(plain["ja"], alone)
        put = F.concat(F.lit("\\$"), t, F.lit("\\$"))
        done = {k: T.restore(F.regexp_replace(plain[k], alone, put), T.math_spans(acc[k])) for k in plain}
        return F.struct(*[F.when(both, done[k]).otherwise(acc[k]).alias(k) for k in done], (acc["n"] + F.when(both, 1).otherwise(0)).alias("n"))

    return F.aggregate(todo, F.struct(en.alias("en"), ja.alias("ja"), F.lit(0).alias("n")), wrap)


def protect_letters(units: DataFrame) -> DataFrame:
    """Single letters left over in ja_text that stand alone, outside maths, in
    both texts become maths in both; a later one sees the earlier edits. letters
    counts them. All of a text's are wrapped at once where it has no stray dollar."""
    en, ja = F.col("en_text"), F.col("ja_text")
    todo = F.array_distinct(F.filter(F.transform(T.leak_candidates(ja), T.strip_unpaired), lambda t: t.rlike(r"^[A-Za-z]\z")))
    d = units.withColumn("_todo", F.when(_flagged(units), todo)).withColumn("_any", F.coalesce(F.size("_todo") > 0, F.lit(False)))
    d = d.withColumn("_en", F.when(F.col("_any"), T.protect(en))).withColumn("_ja", F.when(F.col("_any"), T.protect(ja)))
    alone = lambda c: F.regexp_extract_all(c, F.lit("(?<![A-Za-z0-9])[A-Za-z](?![A-Za-z0-9])"), F.lit(0))
    d = d.withColumn("_good", F.array_intersect(F.array_intersect("_todo", alone("_en")), alone("_ja")))
    stray = F.col("_en").contains("$") | F.col("_ja").contains("$")
    pattern = F.concat(F.lit("(?<![A-Za-z0-9])(["), F.array_join("_good", ""), F.lit("])(?![A-Za-z0-9])"))
    at_once = F.struct(*[T.restore(F.regexp_replace(f"_{k}", pattern, F.lit(r"\$$1\$")), T.math_spans(c)).alias(k) for k, c in (("en", en), ("ja", ja))], F.size("_good").alias("n"))
    start = F.struct(en.alias("en"), ja.alias("ja"), F.lit(0).alias("n"))
    d = d.withColumn("_t", F.when(F.col("_any") & stray, _letter_by_letter(F.col("_todo"), en, ja)).when(F.size("_good") > 0, at_once).otherwise(start))
    return d.withColumn("en_text", F.col("_t.en")).withColumn("ja_text", F.col("_t.ja")).withColumn("letters", F.col("_t.n")).drop("_t", "_todo", "_any", "_en", "_ja", "_good")


def merge_math(units: DataFrame) -> DataFrame:
    """Function calls, then comparisons, drawn into their maths spans in ja_text;
    in en_text too where the same literal stands. calls and comparisons are 1 where
    ja_text changed."""
    for name, finder in (("calls", T.function_calls), ("comparisons", T.comparisons)):
        units = units.withColumn("_c", F.when(_flagged(units), finder(F.col("ja_text"))))
        found = F.size("_c") > 0
        changed = {c: F.when(found, T.replace_first(F.col(c), F.col("_c"))).otherwise(F.col(c)) for c in ("ja_text", "en_text")}
        units = units.withColumn(name, found.cast("int")).withColumns(changed).drop("_c")
    return units


def repair_math(units: DataFrame) -> DataFrame:
    """Letters first: a comparison may be merged with one that became maths."""
    return merge_math(protect_letters(units))


def repair_counts(repaired: DataFrame, *by: str) -> DataFrame:
    """How much repair_math() changed: letters, calls and comparisons, of everything
    or by columns."""
    return repaired.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("letters", "calls", "comparisons")])


def unknown_leaks(units: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, tag, token): candidates left in the ja_text of translatable units that
    known(token) does not allow."""
    found = units.where(_flagged(units)).select("doc_id", "tag", F.explode(F.array_distinct(T.leak_candidates(F.col("ja_text")))).alias("token"))
    return found.join(known.select("token").distinct(), "token", "left_anti").select("doc_id", "tag", "token")
