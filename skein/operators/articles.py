"""Article cleaning: a text without what surrounds an article on its page, as array expressions over its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, references
from ..functions.text import compare_key, first_set, fold, let, squeeze, worked_out

# Fixed values, each list in the order in which it is tried.
#: Phrases of banners, wherever they stand.
BANNERS = ("aceptar cookies", "cookie policy", "suscr[ií]bete", "newsletter", "iniciar sesi[oó]n")
#: What follows an article within its last block.
CUTS = (
    "Overall Score", "Related Posts?", "Related Articles?", "More Stories", "More From", "Recommended Articles?", "About the Author", "Author Bio", "[ÚU]ltimas Noticias",
    "M[áa]s de (?:Cultura|Sociedad|Estados|Capital|Ciencia|Opin[ií]on)", "Publicidad Comercial", "Lo m[áa]s visto", "M[áa]s le[ií]das",
)
#: Widgets inside a block.
WIDGETS = (r"View this post on Instagram\s+A post shared by\s+.*?\)\s*", r"A post shared by\s+.*?\)\s*", r"Share this article\s*", r"Sign up for (?:our|the) newsletter\s*")
#: How a folded block begins that is no part of an article.
BOILERPLATE = (
    "view this post on instagram", "a post shared by", "related posts?", "recommended", "read more", "more from", "subscribe", "newsletter", "advertisement", "publicidad", "cookies?",
    "privacy policy", "terms of use", "copyright", "all rights reserved", "share this", "follow us", "comments?", "tags?", "overall score",
)
NETWORKS = ("facebook", "twitter", "instagram", "linkedin")
#: Where an article ends: the first folded block that has one.
TAILS = (
    "related posts", "related articles", "more stories", "more from", "recommended articles", "about the author", "author bio", "ultimas noticias", "mas de cultura", "mas de sociedad",
    "mas de estados", "mas de capital", "mas de ciencia", "mas de opinion", "publicidad comercial", "quienes somos", "copyright", "todos los derechos reservados", "advertisement",
    "newsletter", "subscribe",
)
#: Signs of a note on the author.
BIOS = ("i strive to", "in addition to my work", "i was previously", "prior to joining", "author")
#: Blocks in which the title is looked for; the words of a block that may hold more than it; blocks in which a note on the author is only cut off, and from where.
TOP, WORDS, OPENING, BIO_FROM, BIO_BACK = 5, 12, 2, 250, 20
#: Fixed value: a date line that may stand between a title and its text.
DATE_LINE = r"^\s*(?:\|\s*)?[A-Za-z0-9 ._-]{0,50}\s*(?:News|Noticias)?\s*[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\s+\d{1,2},\s+\d{4}\s+(?:[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ._-]+\s*){0,5}(?:News|Noticias)?\s*"

NO_TEXTS = "array<string>"


def unescape(text: Column) -> Column:
    """Character references written out; a space that doesn't break is a space."""
    return F.replace(references.unescape(F.coalesce(text, F.lit(""))), F.lit("\u00a0"), F.lit(" "))


def clean_text(text: Column) -> Column:
    """White space squeezed, banners' phrases gone."""
    return squeeze(F.regexp_replace(squeeze(text), rf"(?i)(?:{'|'.join(BANNERS)})", " "))


def blocks_of(text: Column) -> Column:
    """Lines that aren't empty, each of them cleaned."""
    return F.filter(F.transform(F.split(unescape(text), r"[\r\n]+"), clean_text), lambda b: b != "")


def cut_inside(block: Column) -> Column:
    """A block up to the first mark of what follows an article."""
    return F.trim(F.regexp_replace(block, rf"(?is)(?U)\b(?:{'|'.join(CUTS)})\b.*$", ""))


def without_widgets(block: Column) -> Column:
    for widget in WIDGETS:
        block = F.regexp_replace(block, f"(?i){widget}", " ")
    return clean_text(block)


def words_in(block: Column) -> Column:
    return F.size(F.filter(F.split(block, r"\s+"), lambda w: w != ""))


def is_boilerplate(block: Column) -> Column:
    def judge(v: Column) -> Column:
        plain, n = v["plain"], words_in(v["block"])
        network = F.lit(False)
        for name in NETWORKS:
            network = network | F.contains(plain, F.lit(name))
        return (F.length(plain) <= 2) | plain.rlike(rf"^(?:{'|'.join(BOILERPLATE)})\b") | ((n <= 4) & network)

    return let(F.struct(block.alias("block"), compare_key(block).alias("plain")), judge)


def place(part: Column, text: Column, start: Column | int = 1) -> Column:
    """Where ``part`` begins in ``text``, from 1, whatever the case; 0 if it doesn't."""
    return F.position(F.lower(part), F.lower(text), F.lit(start) if isinstance(start, int) else start)


def past_title(block: Column, core: Column, otherwise: Column) -> Column:
    """What follows the second mention of the title's core, or the only one; ``otherwise`` without any."""

    def rest(v: Column) -> Column:
        n = F.length(core)
        second = F.when(v["at"] > 0, place(core, block, v["at"] + n)).otherwise(F.lit(0))
        end = F.when(second > 0, second + n).otherwise(v["at"] + n)
        return F.when(v["at"] > 0, F.substr(block, end)).otherwise(otherwise)

    return F.when(core != "", let(F.struct(place(core, block).alias("at")), rest)).otherwise(otherwise)


def without_title(blocks: Column, title: Column, site_names: bool = True) -> Column:
    """``array<struct<block, touched>>``: blocks at the top that repeat the title go (null) or lose it.

    A title's core is what stands before the name of a site; without ``site_names`` it is the title.
    """

    def judged(t: Column) -> Column:
        def one(block: Column, i: Column) -> Column:
            def by(v: Column) -> Column:
                plain, long = v["plain"], words_in(block) > WORDS
                held, begins = F.contains(plain, t["plain"]), (t["core_plain"] != "") & F.startswith(plain, t["core_plain"])
                at = place(t["title"], block)
                replaced = F.concat(F.substr(block, F.lit(1), at - 1), F.lit(" "), F.substr(block, at + F.length(t["title"])))
                shorter = F.when(at > 0, replaced).otherwise(past_title(block, t["core"], block))
                led = F.regexp_replace(past_title(block, t["core"], F.substr(block, F.length(t["core"]) + 1)), DATE_LINE, " ")
                same = F.struct(block.alias("block"), F.lit(0).alias("touched"))
                return (
                    F.when((i >= TOP) | (t["title"] == ""), same)
                    .when(F.contains(t["plain"], plain), F.struct(F.lit(None).cast("string").alias("block"), F.lit(1).alias("touched")))
                    .when(long & held, F.struct(clean_text(shorter).alias("block"), F.lit(1).alias("touched")))
                    .when(long & begins, F.struct(clean_text(led).alias("block"), F.lit(1).alias("touched")))
                    .when(long, F.struct(clean_text(block).alias("block"), F.lit(0).alias("touched")))
                    .otherwise(same)
                )

            return let(F.struct(compare_key(block).alias("plain")), by)

        return F.transform(blocks, one)

    core = F.trim(F.split(title, r"\s+[–—-]\s+|\s+\|\s+", 2)[0]) if site_names else title
    return let(F.struct(title.alias("title"), core.alias("core"), compare_key(title).alias("plain"), compare_key(core).alias("core_plain")), judged)


def has_any(plain: Column, marks: Column) -> Column:
    return let(plain, lambda p: F.exists(marks, lambda m: F.contains(p, m)))


def first_place(flags: Column) -> Column:
    """The index, from 1, of the first that is true; 0 if none is."""
    return F.coalesce(F.array_position(flags, F.lit(True)), F.lit(0)).cast("int")


def tail_place(blocks: Column, more: Column) -> Column:
    """The first block with a mark of the article's end: the common ones and the source's own, ``more``."""
    marks = F.concat(F.array(*map(F.lit, TAILS)), more)
    return first_place(F.transform(blocks, lambda b: has_any(compare_key(b), marks)))


def bio_place(blocks: Column) -> Column:
    """``at, keep``: the first block with a note on the author, 0 if none, and how many of its characters stay, none after the opening."""

    def one(block: Column, i: Column) -> Column:
        def by(plain: Column) -> Column:
            far = F.filter(F.transform(F.array(*map(F.lit, BIOS)), lambda m: F.position(m, plain) - 1), lambda p: p > BIO_FROM)
            return F.when((i >= OPENING) & has_any(plain, F.array(*map(F.lit, BIOS))), F.lit(0)).when((i < OPENING) & (F.size(far) > 0), F.get(far, F.lit(0)) - BIO_BACK)

        return let(compare_key(block), by)

    def found(keeps: Column) -> Column:
        at = first_place(F.transform(keeps, lambda k: k.isNotNull()))
        return F.struct(at.alias("at"), F.coalesce(F.get(keeps, at - 1), F.lit(0)).alias("keep"))

    return let(F.transform(blocks, one), found)


def distinct_blocks(blocks: Column) -> Column:
    """Blocks whose folded form is new."""
    keys = F.transform(blocks, compare_key)
    return let(keys, lambda k: F.filter(blocks, lambda b, i: F.array_position(k, F.get(k, i)) == i + 1))


def analysis_text(text: Column) -> Column:
    """Folded words without addresses, for analysis."""
    bare = F.regexp_replace(fold(unescape(text)), r"https?://\S+|www\.\S+", " ")
    return squeeze(F.regexp_replace(bare, r"[^a-z0-9áéíóúüñ\s-]", " "))


def measured(text_clean: Column) -> dict[str, Column]:
    normalized = analysis_text(text_clean)
    return {
        "text_normalized": normalized,
        "word_count": F.size(F.regexp_extract_all(normalized, F.lit(r"[a-z0-9áéíóúüñ]+"), 0)),
        "paragraph_count": F.size(F.filter(F.split(text_clean, "\n\n"), lambda p: F.trim(p) != "")),
    }


def clean(records: DataFrame, raw: str = "text_raw_visible", tail_marks: str | None = None, site_names: bool = True) -> DataFrame:
    """Adds ``text_clean, text_normalized, word_count, paragraph_count, cleaning_notes`` to ``records`` with a ``title``.

    ``tail_marks``: a column with the source's own marks of an article's end, folded.
    ``site_names``: titles may end with a dash or a bar and the name of a site.
    Null texts and titles count as empty. Each step is one column over the array of blocks.
    """
    title = F.coalesce("title", F.lit(""))
    own = F.coalesce(F.col(tail_marks), F.array().cast(NO_TEXTS)) if tail_marks else F.array().cast(NO_TEXTS)
    rows = worked_out(records, x_all=F.filter(F.transform(F.transform(blocks_of(F.col(raw)), cut_inside), without_widgets), lambda b: b != ""))
    rows = worked_out(rows, x_own=F.filter("x_all", lambda b: ~is_boilerplate(b)))
    rows = worked_out(rows, x_titled=without_title(F.col("x_own"), title, site_names))
    rows = worked_out(rows, x_bare=F.filter(F.transform("x_titled", lambda x: x["block"]), lambda b: b.isNotNull()), x_touched=F.aggregate("x_titled", F.lit(0), lambda n, x: n + x["touched"]))
    rows = worked_out(rows, x_tail=tail_place(F.col("x_bare"), own))
    rows = worked_out(rows, x_body=F.when(F.col("x_tail") > 0, F.slice("x_bare", 1, F.greatest(F.lit(0), F.col("x_tail") - 1))).otherwise(F.col("x_bare")))
    rows = worked_out(rows, x_bio=bio_place(F.col("x_body")))
    at, keep = F.col("x_bio.at"), F.col("x_bio.keep")
    last = F.when(keep > 0, F.array(F.trim(F.substr(F.get("x_body", at - 1), F.lit(1), keep)))).otherwise(F.array().cast(NO_TEXTS))
    rows = worked_out(rows, x_text=F.when(at > 0, F.concat(F.slice("x_body", 1, F.greatest(F.lit(0), at - 1)), last)).otherwise(F.col("x_body")))
    rows = worked_out(rows, x_once=distinct_blocks(F.col("x_text")))
    gone = F.size("x_all") - F.size("x_own")
    again = F.size("x_text") - F.size("x_once")
    notes = [
        F.when(gone > 0, F.concat(F.lit("removed_boilerplate_blocks:"), gone.cast("string"))),
        F.when(F.col("x_touched") > 0, F.concat(F.lit("removed_repeated_title_blocks:"), F.col("x_touched").cast("string"))),
        F.when(F.col("x_tail") > 0, F.lit("cut_after_related_content")),
        F.when(at > 0, F.lit("cut_author_bio_tail")),
        F.when(again > 0, F.concat(F.lit("removed_duplicate_blocks:"), again.cast("string"))),
    ]
    joined = F.regexp_replace(F.regexp_replace(F.array_join("x_once", "\n\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    out = worked_out(rows.drop("text_clean", "text_normalized", "word_count", "paragraph_count", "cleaning_notes"), text_clean=F.regexp_replace(joined, r"^\s+|\s+$", ""))
    out = out.withColumns(measured(F.col("text_clean"))).withColumn("cleaning_notes", F.filter(F.array(*notes), lambda n: n.isNotNull()))
    return out.drop(*[c for c in out.columns if c.startswith("x_")])


def clean_metadata(records: DataFrame, raw: str) -> DataFrame:
    """The same columns for a title or a snippet, which nothing is cut from but banners and widgets."""
    out = worked_out(records.drop("text_clean", "text_normalized", "word_count", "paragraph_count", "cleaning_notes"), text_clean=without_widgets(clean_text(unescape(F.col(raw)))))
    figures = measured(F.col("text_clean")) | {"paragraph_count": F.when(F.col("text_clean") != "", 1).otherwise(0)}
    return out.withColumns(figures).withColumn("cleaning_notes", F.array(F.lit("partial_metadata_text")))


def reclean(records: DataFrame) -> DataFrame:
    """Records cleaned and classified again from their visible text, or from the clean one without it; full ones that nothing is left of are too short."""
    from .records import classify_source, from_map

    source = first_set(F.col("text_raw_visible"), F.col("text_clean"))
    rows = clean(records.withColumn("text_raw_visible", source)).withColumn("text_length", F.length("text_clean"))
    rows = worked_out(rows, x_class=classify_source(F.col("url"), F.col("medium"), F.col("title")))
    level = {k: v[0] for k, v in lexicon.EVIDENCE.items()}, {k: v[1] for k, v in lexicon.EVIDENCE.items()}
    kind = F.col("x_class.source_type")
    new = {
        "source_type": kind, "source_type_confidence": F.col("x_class.confidence"), "source_type_evidence": F.col("x_class.evidence"),
        "evidence_level": from_map(level[0], kind), "evidence_weight": from_map(level[1], kind),
        "status": F.when((F.col("status") == "ok") & (F.col("text_length") == 0), "too_short").otherwise(F.col("status")),
    }
    return rows.withColumns(new).drop("x_class")
