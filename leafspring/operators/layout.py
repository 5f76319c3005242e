"""Layout items other than text: figures with their captions, equations, lists,
and whatever has no operator of its own. Windows are per document and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .document import absolute_page, add_labels, drop_noise, restore_compounds, so_far

FIGURES = ("image", "table", "chart")
CAPTIONS = ("image_caption", "table_caption", "chart_caption", "code_caption")


def _filled(a: Column) -> Column:
    return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), T.strip), lambda s: s != "")


def _complete(items: DataFrame) -> DataFrame:
    """items with every column that operators ask for."""
    for c, kind in (*((c, "array<string>") for c in (*CAPTIONS, "list_items")), *((c, "string") for c in ("text", "img_path", "table_body", "code_body")), ("text_level", "int"), ("page_idx", "int")):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast(kind))
    return items


def normalise_items(items: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """items with their texts, list entries and captions normalised (what has no
    operator of its own stays raw): stripped, bare letters of equations and Greek
    wrapped as maths, and, given a lexicon(word), the hyphens of merged compounds put
    back. Compounds are found once for each distinct word, by joins; only words that
    change come back to the texts."""
    d, kind = _complete(items), F.coalesce("type", F.lit(""))
    figure = kind.isin(*FIGURES) & F.col("img_path").isNotNull()
    places = {"text": kind.isin("text", "page_footnote"), "list_items": kind == "list", **{c: figure for c in CAPTIONS}}
    each = lambda c, f: f(F.col(c)) if c == "text" else F.transform(_filled(F.col(c)), f)
    for c, here in places.items():
        d = d.withColumn(c, F.when(here, each(c, lambda t: T.normalise(T.strip(t)))).otherwise(F.col(c)))
    if lexicon is None:
        return d
    texts = F.concat(*[F.when(here, F.array(c) if c == "text" else F.coalesce(c, F.array())).otherwise(F.array().cast("array<string>")) for c, here in places.items()])
    plain = F.regexp_replace(F.array_join(texts, "\n"), r"\$[^$]*\$", r"\$")
    words = d.select("doc_id", "ord", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?U)\b[a-z]{6,}\b"), F.lit(0)))).alias("word"))
    fixes = restore_compounds(words, lexicon)
    per_item = words.join(fixes, "word").groupBy("doc_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("_fixes"))
    d = d.join(per_item, ["doc_id", "ord"], "left")
    for c, here in places.items():
        d = d.withColumn(c, F.when(here & F.col("_fixes").isNotNull(), each(c, lambda t: T.replace_words(t, F.col("_fixes")))).otherwise(F.col(c)))
    return d.drop("_fixes")


def caption_groups(captions: Column) -> Column:
    """Labelled captions as array of (text, kind, number): one without a label
    goes on with the one before; those before the first label are dropped."""
    kinds = "array<struct<text:string,kind:string,number:int>>"
    parts = F.transform(_filled(captions), lambda s: F.struct(s.alias("text"), T.caption_kind(s).alias("kind"), T.caption_number(s).alias("number")))

    def add(groups, c):
        last = F.element_at(groups, -1)
        longer = F.struct(F.concat_ws(" ", last["text"], c["text"]).alias("text"), last["kind"].alias("kind"), last["number"].alias("number"))
        joined = F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(longer))
        return F.when(c["kind"].isNotNull() | (F.size(groups) == 0), F.concat(groups, F.array(c))).otherwise(joined).cast(kinds)

    return F.filter(F.aggregate(parts, F.array().cast(kinds), add), lambda g: g["kind"].isNotNull())


def raw_text(columns: list[str]) -> Column:
    """The first of text, bodies, list entries and captions that holds something."""
    have = [c for c in ("text", "table_body", "code_body") if c in columns]
    parts = [F.when(T.strip(F.col(c)) != "", T.strip(F.col(c))) for c in have]
    for names, sep in ((("list_items",), "\n"), (CAPTIONS, " ")):
        parts += [F.when(F.size(c) > 0, F.array_join(F.filter(c, lambda s: s != ""), sep)) for c in names if c in columns]
    return F.coalesce(*parts, F.lit(""))


def _marked(d: DataFrame) -> DataFrame:
    """Items (normalised, with page) that show something, with what elements()
    tells of them in columns that begin with _."""
    kind = F.coalesce("type", F.lit(""))
    of = lambda c: F.when(F.size(c) > 0, F.col(c))
    is_fig = kind.isin(*FIGURES) & F.col("img_path").isNotNull()
    labels = F.when(is_fig, caption_groups(F.coalesce(of("image_caption"), of("table_caption"), of("chart_caption"))))
    element = F.when(is_fig, "figure").when(kind == "equation", "equation").when(kind == "list", "list").when(kind.isin("text", "page_footnote"), "text").otherwise("unknown")
    d = d.select(
        "*", raw_text(d.columns).alias("_raw"), labels.alias("_labels"), T.strip_fences(T.strip(F.coalesce("text", F.lit("")))).alias("_latex"),
        F.when(kind == "list", _filled(F.col("list_items"))).alias("_list"), element.alias("_element"),
        F.when(kind.isin(*FIGURES) & ~is_fig, "no image").when(element == "unknown", "unknown type").alias("_reason"),
    )
    shown = F.when(F.col("_element") == "equation", F.col("_latex") != "").when(F.col("_element") == "list", F.size("_list") > 0).when(F.col("_element") == "text", T.strip(F.coalesce("text", F.lit(""))) != "")
    d = d.where(F.coalesce(shown, F.lit(True)))

    page = Window.partitionBy("doc_id", "page").orderBy("ord")
    before, after = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(1, Window.unboundedFollowing)
    bare = (F.col("_element") == "figure") & (F.size("_labels") == 0)
    tag = T.equation_number(F.col("text"))
    counts = bare | ((F.col("_element") == "equation") & tag.isNull())
    d = d.withColumn("_rn", F.row_number().over(page)).withColumn("_bare", bare)
    d = d.withColumn("_run", F.col("_rn") - 1 - F.coalesce(F.max(F.when(~F.col("_bare"), F.col("_rn"))).over(before), F.lit(0)))
    d = d.withColumn("_given", F.when(F.size("_labels") > 1, F.least(F.size("_labels") - 1, F.col("_run"))).otherwise(0))
    d = d.withColumn("_next", F.first(F.when(~F.col("_bare"), F.struct("_rn", "_given", "_labels")), True).over(after))
    away = F.col("_next._rn") - F.col("_rn")
    got = F.when(F.col("_bare"), F.when(away <= F.col("_next._given"), F.get("_next._labels", F.col("_next._given") - away))).otherwise(F.get("_labels", F.col("_given")))
    d = d.withColumn("_label", got).withColumn("_count", F.sum(counts.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    fig, eq = F.col("_element") == "figure", F.col("_element") == "equation"
    own = Window.partitionBy("doc_id", "page", "_element", "type").orderBy("ord")
    return d.withColumn("_unknown", F.row_number().over(own)).drop("_rn", "_bare", "_run", "_given", "_next", "_labels").withColumns({
        "_kind": F.when(fig, F.coalesce("_label.kind", F.when(kind == "table", "table").otherwise("figure"))),
        "_number": F.when(fig, F.coalesce("_label.number", "_count")).when(eq, F.coalesce(tag, "_count")),
        "_labeled": F.when(fig, F.col("_label").isNotNull()).when(eq, tag.isNotNull()),
        "_sentences": F.when(fig, T.split_sentences(F.col("_label.text"))).when(F.col("_element") == "list", F.col("_list")),
    })


def elements(items: DataFrame, page_offset: int = 0, lexicon: DataFrame | None = None) -> DataFrame:
    """One row per item that is no text: doc_id, ord, page, element (figure,
    equation, list, unknown), kind (figure or table), number, labeled,
    image_path, text (LaTeX or raw), sentences (the caption's, or the list's),
    unknown_number (of unknown ones by type on their page) and reason (why it is
    unknown).

    A figure with several labelled captions hands the first ones to the unlabelled
    figures just before it, as many as there are, one being left for itself; what
    then is over is dropped. Figures without label and equations without \\tag
    share one counter a page, and use it up even if a label comes later. A figure
    without path is unknown; empty equations and lists vanish. Null columns
    count as missing, a null type as unknown."""
    d = _marked(normalise_items(drop_noise(items), lexicon).withColumn("page", absolute_page(page_offset)))
    eq, unknown = F.col("_element") == "equation", F.col("_element") == "unknown"
    return d.where("_element <> 'text'").select(
        "doc_id", "ord", "page", F.col("_element").alias("element"), F.col("_kind").alias("kind"), F.col("_number").alias("number"), F.col("_labeled").alias("labeled"),
        F.col("img_path").alias("image_path"), F.when(eq, F.col("_latex")).when(unknown, F.col("_raw")).alias("text"), F.col("_sentences").alias("sentences"),
        F.when(unknown, F.col("_unknown")).alias("unknown_number"), F.col("_reason").alias("reason"),
    )


def _file_name(element: Column, kind: Column, page: Column, number: Column, labeled: Column) -> Column:
    prefix = F.when(element == "equation", "eq").when(kind == "table", "table").otherwise("fig")
    return F.concat(prefix, F.lit("_p"), page.cast("string"), F.when(labeled, "_").otherwise("_unlabeled"), number.cast("string"), F.lit(".png"))


def image_names(d: DataFrame) -> DataFrame:
    """file_name of every figure and equation of elements()."""
    name = _file_name(*(F.col(c) for c in ("element", "kind", "page", "number", "labeled")))
    return d.withColumn("file_name", F.when(F.col("element").isin("figure", "equation") & F.col("image_path").isNotNull(), name))


def units(items: DataFrame, page_offset: int = 0, lexicon: DataFrame | None = None) -> DataFrame:
    """The unit table, one row for each thing that has a tag: titles, authors,
    affiliations, headings, sentences of texts, lists and captions, images, LaTeX and
    unknown items, in the order of the document.

    doc_id, ord (page and item: the order within a document, with pos), pos, page,
    tag, kind, en_text, image_path (of images: where the picture goes), reason.
    Sentences are counted by page and by section, which a heading begins anew even if
    it repeats; those of captions count for themselves. All windows but one local
    sort share one shuffle by document."""
    d = _marked(add_labels(normalise_items(drop_noise(items), lexicon), page_offset))
    element, p = F.col("_element"), F.concat(F.lit("P"), F.col("page").cast("string"), F.lit("-"))
    row = lambda kind, text, image=None: F.struct(F.lit(kind).alias("kind"), text.alias("en_text"), (F.lit(None) if image is None else image).cast("string").alias("image_path"))
    none = F.array().cast("array<struct<kind:string,en_text:string,image_path:string>>")
    file = F.concat(F.lit("images/"), _file_name(element, F.col("_kind"), F.col("page"), F.col("_number"), F.col("_labeled")))
    picture = lambda kind: F.when(F.col("img_path").isNotNull(), F.array(row(kind, F.lit(""), file))).otherwise(none)
    label = F.create_map(*map(F.lit, ("TITLE", "title", "AUTHORS", "authors", "AFFIL", "affil")))[F.col("label")]
    one = F.struct(label.alias("kind"), F.col("txt").alias("en_text"), F.lit(None).cast("string").alias("image_path"))
    parts = (
        F.when(F.col("label").isNotNull(), F.array(one)).when(F.col("is_heading"), F.array(row("heading", F.col("txt"))))
        .when(element == "text", F.transform(T.split_sentences(F.col("txt")), lambda s: row("body_sentence", s))).when(element == "list", F.transform("_sentences", lambda s: row("body_sentence", s)))
        .when(element == "figure", F.concat(picture("figure_image"), F.transform(F.coalesce("_sentences", F.array().cast("array<string>")), lambda s: row("caption_sentence", s))))
        .when(element == "equation", F.concat(picture("equation_image"), F.array(row("equation_latex", F.concat(F.lit("$$"), F.col("_latex"), F.lit("$$"))))))
        .otherwise(F.array(row("unknown", F.col("_raw"))))
    )
    prefix = F.when(element == "equation", "EQ").when(F.col("_kind") == "table", "TABLE").otherwise("FIG")
    own = F.concat(p, prefix, F.when(F.col("_labeled"), "").otherwise("-UNLABELED"), F.col("_number").cast("string"))
    own = F.when(element.isin("figure", "equation"), own).when(element == "unknown", F.concat(p, F.lit("UNKNOWN-"), F.coalesce("type", F.lit("None")), F.lit("-"), F.col("_unknown").cast("string")))
    own = F.when(F.col("label").isNotNull(), F.concat(p, "label")).when(F.col("is_heading"), F.concat(p, F.lit("HEADING-"), F.col("heading_id"))).otherwise(own)
    place = F.shiftleft(F.col("page").cast("long"), 32) + F.col("ord")
    d = d.select("doc_id", place.alias("ord"), "page", "section", "is_heading", own.alias("own"), F.when(element == "unknown", F.col("_reason")).alias("reason"), F.posexplode(parts).alias("pos", "u"))
    d = d.select("doc_id", "ord", "pos", "page", "section", "is_heading", "own", "reason", "u.*")
    body = (F.col("kind") == "body_sentence").cast("int")
    doc = so_far(Window.partitionBy("doc_id").orderBy("ord", "pos"))
    d = d.withColumn("_all", F.sum(body).over(doc))
    d = d.withColumn("_in", F.col("_all") - F.coalesce(F.max(F.when(F.col("is_heading"), F.col("_all"))).over(doc), F.lit(0)))
    d = d.withColumn("_on", F.sum(body).over(so_far(Window.partitionBy("doc_id", "page").orderBy("ord", "pos"))))
    n = lambda c: F.col(c).cast("string")
    tag = (
        F.when(F.col("kind") == "body_sentence", F.concat(p, F.lit("S"), n("_on"), F.lit("-"), F.col("section"), F.lit("-S"), n("_in")))
        .when(F.col("kind") == "caption_sentence", F.concat("own", F.lit("-CAPTION-S"), n("pos"))).when(F.col("kind") == "equation_latex", F.concat("own", F.lit("-LATEX"))).otherwise(F.col("own"))
    )
    return d.select("doc_id", "ord", "pos", "page", tag.alias("tag"), "kind", "en_text", "image_path", "reason")
