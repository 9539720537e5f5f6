"""Template residue and error pages.

Three kinds of evidence: placeholder detectors on the page's text in several readings,
filler detectors, and, for messages, titles that their bodies don't take up and pages
that say little, combined with what is known of their host. These pages have no address;
the title line and the source stand for slug and host.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.mixing import source_name
from headway.llm.pages import BREAKS, COLUMN_GAP
from headway.sources.tables import checkpointed

#: Letters of a word that counts when title and body are compared, and how many of its first letters do.
TERM, STEM = 4, 6
#: Lines looked at first, for speed only.
HEAD = 12
#: Words of a line for each message phrase in it; a quoted message is reported speech.
LINE = 16

# Names of slots that single braces hold; other single words in single braces may be earnest.
SLOTS = (
    "name", "town", "editor", "teaser", "advertiser", "headline", "byline", "subscriber", "caption", "price", "weather", "edition", "printer",
    "title", "author", "date", "column", "page", "issue", "paper", "user", "item", "article", "body", "email", "city", "address", "url", "link", "image", "text",
)
#: A slot's name: a letter, then one to six words of letters, digits and the signs of identifiers.
_S = r"\s*[A-Za-z][\w.\-\[\]]*?(?:\s[\w.\-\[\]]+?){0,5}?\s*"
_NAME = r"[A-Za-z][A-Za-z0-9]*"
PLACEHOLDERS = (
    rf"\{{\{{{_S}\}}\}}", rf"[$#]\{{{_S}\}}", rf"<%=?{_S}%>", rf"\{{%{_S}%\}}", rf"%%{_S}%%", rf"@@{_S}@@", rf"(?<!\w)__{_S}__(?!\w)",
    rf"(?<!\w)\$(?=[A-Za-z]){_S}(?<!\s)\$(?!\w)", rf"<<{_S}>>", rf"&lt;{_S}&gt;", rf"\[\[{_S}\]\]", rf"\?\?{_S}\?\?", rf"%\({_S}\)[sd]",
    r"(?<![\w%])%[sd](?!\w)", r"%d[./-]%m[./-]%[Yy]", r"\{\d{1,2}\}", r"\[object\s+Object\]", r"\[T[KC]\]", rf"\[{_S}\s+goes\s+here\]",
    r"(?i:\[insert\s(?:\S+\s){1,8}?here\])", rf"(?i:\[your\s){_S}\]", rf"(?i:<insert\s){_S}>", r"<[A-Z][A-Z_.\-]+(?: [A-Z_.\-]+){0,5}(?:\s?\d+|\[\d+\])?>",
    rf"\{{{_NAME}(?:[_.]{_NAME})+\}}", r"\{[a-z]+(?:[A-Z][a-z0-9]*)+\}", rf"(?i:\{{(?:{'|'.join(SLOTS)})(?:[_. ]?[a-z0-9]+|\[\d\])*\}})",
)
#: Signs that the above begin with.
_BEGINS = r"(?=[{\[<@$%#?&_])"
#: An empty value, or the pattern of a date, printed as it is.
EMPTY = (r"\bnull null\b", r"\bundefined, undefined\b", r"\bXX/XX/XXXX\b", r"\bDD/MM/YYYY\b")
#: What every placeholder contains, as a cheap first look.
_MARKS = r"[{}\[\]<>@$%]|__|\?\?|&lt;|null null|undefined, undefined|XX/XX|DD/MM"

# Words of meaningless filler, invented ones and those of the two customary passages, and sentences of filler in several languages.
FILLER_WORDS = (
    "lorem", "ipsum", "dolor", "dolora", "belisque", "congue", "tincul", "massur", "egestal", "fermat", "portil", "vestor", "nulsa", "ultram", "sedara",
    "pelenti", "nomper", "quorem", "astum", "aculis", "veniat", "consectetur", "adipiscing", "eiusmod", "tempor", "incididunt", "aliqua", "exercitation", "ullamco", "laboris",
    "reprehenderit", "voluptate", "excepteur", "occaecat", "cupidatat", "perspiciatis", "unde", "omnis", "iste", "natus", "voluptatem", "accusantium", "doloremque", "laudantium",
    "totam", "aperiam", "eaque", "inventore", "veritatis", "architecto", "beatae", "explicabo", "nemo", "quia", "voluptas", "aspernatur", "consequuntur",
)
#: What a page says that announces its own filler.
_FILLS = r"(?:a |an |the |some |only |just )*(?:placeholder|dummy|sample|filler|example) (?:copy|text|paragraph|content|story|article)"
FILLER = (
    r"text to come, text to come", r"dummy copy to fill", r"sample text for layout", r"type your story in this", r"body text goes here", r"your text here",
    r"placeholder paragraph", r"paragraph, replace before printing", r"asdf asdf", r"jkl jkl", r"\bxxx+ xx+ xx+", r"ist ein blindtext", r"steht sp.ter der artikel",
    r"mustertext f.r die spalte", r"dit is opvultekst", r"voorbeeldtekst, nog te", r"est un faux texte", r"texte de l.article viendra", r"exemple de paragraphe .? ?remplacer",
    r"hier komt (?:later )?het artikel", r"hier komt later",
    r"this is " + _FILLS, r"here (?:is|comes) " + _FILLS, r"following is " + _FILLS,
    r"\bes (?:un |el |s.lo )*(?:texto|p.rrafo) (?:de |simulado|falso)", r"texto de (?:relleno|ejemplo|muestra|prueba)", r"aqu. (?:va|ir.) el texto", r"testo (?:segnaposto|di (?:riempimento|esempio|prova))", r"texto de preenchimento",
)


def _by_letter(patterns: tuple[str, ...]) -> str:
    """Alternatives at the beginning of a word, told apart by their first letter first."""
    groups: dict[str, list[str]] = {}
    for p in patterns:
        bare = p.removeprefix(r"\b")
        groups.setdefault(bare[0] if bare[0].isalpha() else "", []).append(bare)
    return r"\b(?:" + "|".join(f"{k}(?:{'|'.join(x[len(k) :] for x in v)})" for k, v in sorted(groups.items())) + ")"


_RUN_OF_FILLER = _by_letter(FILLER_WORDS) + r"(?:\W+" + _by_letter(FILLER_WORDS) + r"\b){2}"

# What error messages and notices that scripts are needed say, in several languages.
MESSAGES = (
    r"not be found", r"page (?:was |is )?not found", r"removed or is not there", r"bad gateway", r"took too long", r"service is unavailable", r"temporarily unavailable",
    r"session has expired", r"error (?:has )?occurred while", r"unexpected error", r"went wrong", r"server did not answer", r"internal server error", r"not have access", r"access denied", r"forbidden",
    r"java ?script", r"\bscripts\b", r"scripting must be", r"nicht gefunden", r"nicht erreichbar", r"fehler aufgetreten", r"zugriff verweigert", r"skripte", r"introuvable", r"indisponible",
    r"erreur est survenue", r"acc.s refus", r"scripts sont", r"niet gevonden", r"niet bereikbaar", r"fout opgetreden", r"geen toegang", r"no encontrad", r"no disponible", r"non trovat",
)
NAVIGATION = (r"home \| ", r"back to", r"print\s+save", r"(?:previous|next) page", r"page viewer", r"zoom in", r"reference\b")


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


_UNSAID = rf"^[^\p{{L}}\p{{N}}]*(?:(?:error|http|oops!?)?[^\p{{L}}]*$|{_any(NAVIGATION)})"


#: A word's break at a line's end.
_BROKEN = rf"[{BREAKS}](?<=\w.)[ \t]*\n"
#: A slot that begins in a line, or in a cell of it, and doesn't end there; or half of an empty value.
_SPLIT = r"(?m)(?:(?:[\[{<]|&lt;|%%|@@|__|\?\?|\$|%\()[^\]}>\n]*?(?: {3}|$)|(?:null|undefined,?)[ \t]*(?: {3}|$))"


def flat(lines: Column) -> Column:
    """Lines as running text, broken words put together."""
    return running(F.array_join(lines, "\n"))


def readings(text: Column, boxes: Column) -> list[Column]:
    """The page's lines as they come, every other line first, cells of wide gaps by column, and by boxes where there are any."""
    lines = F.split(text, "\n")
    alternate = F.concat(F.filter(lines, lambda _, i: i % 2 == 0), F.filter(lines, lambda _, i: i % 2 == 1))
    cells = F.transform(lines, lambda x: F.split(x, r" {3,}"))
    columns = F.sequence(F.lit(0), F.array_max(F.transform(cells, F.size)) - 1)
    by_column = F.flatten(F.transform(columns, lambda k: F.filter(F.transform(cells, lambda row: F.get(row, k)), lambda x: x.isNotNull())))
    starts = F.array_sort(F.array_distinct(boxes["x0"]))
    edges = F.filter(starts, lambda x, i: (i > 0) & (x - F.get(starts, i - 1) > COLUMN_GAP))
    placed = F.transform(F.arrays_zip(lines.alias("t"), boxes.alias("b")), lambda z: F.struct(F.size(F.filter(edges, lambda e: e <= z["b"]["x0"])).alias("c"), z["b"]["y0"].alias("y"), z["t"].alias("t")))
    by_box = F.when(F.size(boxes) == F.size(lines), F.transform(F.array_sort(placed), lambda z: z["t"]))
    return [lines, alternate, by_column, by_box]


def has_placeholder(text: Column) -> Column:
    return text.rlike(f"{_BEGINS}(?:{_any(PLACEHOLDERS)})") | (text.rlike("null|undefined|XX/|DD/") & text.rlike(_any(EMPTY)))


def has_filler(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(_by_letter(FILLER)) | low.rlike(_RUN_OF_FILLER)


def running(text: Column) -> Column:
    """A page's text with broken words put together and blanks made single."""
    return F.regexp_replace(F.regexp_replace(text, _BROKEN, ""), r"[\n\t\r\f]\s*| \s+", " ")


def residue_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, placeholder, filler) of pages that hold template residue or filler.

    Only pages where a slot begins in a line and doesn't end there are read in other orders too.
    Pages with NULL or empty text hold nothing.
    """
    text = F.col("text")
    pages = documents.where(text.isNotNull()).select("doc_id", "text", F.col("lines").alias("_boxes"))
    looked = pages.withColumn("_plain", running(text)).withColumn("_mark", F.col("_plain").rlike(_MARKS))
    looked = looked.withColumn("filler", has_filler(F.col("_plain"))).withColumn("_first", F.col("_mark") & has_placeholder(F.col("_plain")))
    others = [F.coalesce(has_placeholder(flat(r)), F.lit(False)) for r in readings(text, F.col("_boxes"))[1:]]
    looked = looked.withColumn("placeholder", F.when(F.col("_first"), True).when(F.col("_mark") & text.rlike(_SPLIT), reduce(lambda a, b: a | b, others)).otherwise(False))
    return looked.where(F.col("placeholder") | F.col("filler")).select("doc_id", "placeholder", "filler")


def line_template(line: Column) -> Column:
    """What a line says apart from its numbers, codes, case and outer punctuation."""
    low = F.regexp_replace(F.lower(line), r"\(code [^)]*\)|\b(?=\w*\d)[0-9a-f]{6,}\b", "")
    low = F.regexp_replace(low, r"^\s*(?:error|http|oops!?)?\s*\d*\s*:?\s*", "")
    return F.regexp_replace(F.regexp_replace(low, r"[\d]+", "9"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def said_lines(lines: Column) -> Column:
    """Lines but those of navigation, bare codes and numbers."""
    return F.filter(lines, lambda x: ~F.lower(x).rlike(_UNSAID))


def rest_of(lines: Column) -> Column:
    """Lines but the first."""
    return F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))


def is_message(line: Column) -> Column:
    """A line that is a listed message: not quoted, and with a message phrase for each `LINE` words."""
    told = line_template(line)
    n = F.size(F.split(line, r"\s+"))
    dense = (n <= LINE) | (F.size(F.regexp_extract_all(told, F.lit(f"({_any(MESSAGES)})"), F.lit(1))) * LINE >= n)
    return ~line.rlike('["\u201c\u201d\u00ab\u00bb]') & told.rlike(_any(MESSAGES)) & dense


def words(lines: Column) -> Column:
    """The distinct words of lines."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.array_join(lines, " ")), r"[^\p{L}]+")), "")


def apart(title: Column, body: Column) -> Column:
    """Whether no term of the title's lines occurs in the body's; the first letters of long words are a term."""
    terms = lambda lines: F.transform(F.filter(words(lines), lambda w: F.length(w) >= TERM), lambda w: F.substring(w, 1, STEM))
    return ~F.arrays_overlap(terms(title), terms(body))


def only_messages(said: Column) -> Column:
    """Whether lines are listed messages or stand in capitals, as headlines that go on do."""
    return F.forall(said, lambda x: ~x.rlike(r"\p{Ll}") | is_message(x))


def plain_message(said: Column) -> Column:
    """Whether lines are listed messages only, under no title or one that the messages don't take up."""
    return only_messages(rest_of(said)) & F.exists(said, is_message) & apart(F.filter(said, lambda x: ~is_message(x)), F.filter(said, is_message))


def error_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, messages, duplicates, host_share) of pages that are an error message or a notice.

    First, pages of any length whose lines are listed messages and navigation, under a
    title or none, that has no term in common with them (`plain_message`). From these
    come two measures, over distinct texts, so that copies count once: a page says little if
    it has no more distinct words than they have (mean and two deviations), and a host
    is suspect if its share of them is above the average of hosts. A page that says
    little on a suspect host is one too, in any language, if its title and body have no
    term in common or its lines all occur on other texts that say little; so is a page
    that says little on any host if it has a message and its other lines so occur.
    """
    text = F.col("text")
    pages = documents.where(text.isNotNull()).select("doc_id", F.coalesce(source_name(F.col("source")), F.lit("")).alias("_host"), "text")
    # The first lines decide for most pages: what fails there, fails on the whole page.
    split, said = F.split(text, "\n"), said_lines(F.split(text, "\n"))
    head = said_lines(F.slice(split, 1, HEAD))
    plain = F.coalesce(only_messages(rest_of(head)) & plain_message(said), F.lit(False))
    size = F.size(words(said))
    # One narrow row a page, looked at once: plain messages with their number of words and of messages.
    looked = pages.withColumn("_plain", plain).select(
        "doc_id", "_host", F.xxhash64(F.lower(text)).alias("_text"), F.when(F.col("_plain"), size).alias("_n"), F.when(F.col("_plain"), F.size(F.filter(said, is_message))).alias("messages")
    )
    looked = checkpointed(looked)
    texts = looked.groupBy("_host", "_text").agg(F.max("_n").cast("double").alias("_n"))
    hosts = texts.groupBy(F.col("_host").alias("_h")).agg(F.avg(F.col("_n").isNotNull().cast("double")).alias("host_share"), F.count("_n").alias("_k"), F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    mean = F.sum("_s") / F.sum("_k")
    spread_of = F.sqrt(F.greatest(F.sum("_q") / F.sum("_k") - mean * mean, F.lit(0.0)))
    # One row: the average of hosts, and how few words are little.
    measures = hosts.agg(F.avg("host_share").alias("_average"), (mean + 2 * spread_of).alias("_little"))
    average, little = (measures.select(c).scalar() for c in ("_average", "_little"))

    brief = pages.where((F.size(words(head)) <= little) & (size <= little) & (size > 0)).withColumn("_said", said)
    brief = checkpointed(brief.withColumn("_text", F.xxhash64(F.lower(text))))  # some percent of the pages
    lines = brief.select("_text", F.explode(F.array_distinct(F.transform("_said", line_template))).alias("_l")).distinct()
    spread = lines.groupBy("_l").agg(F.count(F.lit(1)).alias("_df"))
    seen = brief.select("doc_id", "_host", "text", "_said", F.explode(F.array_distinct("_said")).alias("_line")).withColumn("_t", line_template(F.col("_line")))
    known = seen.join(spread, F.col("_t") == F.col("_l"))
    message, recurs = is_message(F.col("_line")), F.col("_df") > 1
    first = F.slice("_said", 1, 1)
    judged = known.groupBy("doc_id", "_host").agg(
        F.sum(message.cast("int")).alias("messages"), F.sum(recurs.cast("int")).alias("duplicates"), F.min(recurs).alias("_recurs"), F.min(message | recurs).alias("_bare"),
        F.first(apart(first, rest_of(F.col("_said")))).alias("_apart"),
        F.first(plain).alias("_plain"), F.first(has_placeholder(flat(F.split(text, "\n"))) | has_filler(flat(F.split(text, "\n")))).alias("_slots"),
    )
    judged = judged.join(hosts, F.col("_host") == F.col("_h"))
    suspect = (F.col("host_share") > average) & (F.col("_apart") | F.col("_recurs"))
    judged = judged.where(~F.col("_plain") & ~F.col("_slots") & (suspect | (F.col("_bare") & (F.col("messages") > 0))))
    columns = ("doc_id", "messages", "duplicates", "host_share")
    sure = looked.where(F.col("_n").isNotNull()).select("doc_id", "_host", "messages", F.lit(0).alias("duplicates"))
    return judged.select(*columns).unionByName(sure.join(hosts, F.col("_host") == F.col("_h")).select(*columns))
