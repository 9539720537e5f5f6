"""Leaks, mixing and residue over small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from headway.llm import leak, mixing, pages, residue

PASSAGE = "Suppose that the narrow yeoman promised ninety distant gardeners and that Selett supplied a hospital near the northern railway, then the fountain would be empty"
DOCS = "doc_id bigint, text string, lines array<struct<line_no:int,x0:int,y0:int,x1:int,y1:int,conf:float>>, source string, item_id string, _line string"


def boxes(places):
    return [(i + 1, x, y, x + 500, y + 30, None) for i, (x, y) in enumerate(places)]


def wrap(words, n):
    return [" ".join(words[i : i + n]) for i in range(0, len(words), n)]


def found(spark, rows, items=((1, PASSAGE),), **kw):
    df = spark.createDataFrame([(i, t, b, "s", "x", "y") for i, (t, b) in enumerate(rows)], DOCS)
    got = leak.leaks(df, spark.createDataFrame(list(items), "item_id bigint, passage string"), **kw)
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_leaks_in_all_layouts(spark):
    w = PASSAGE.split()
    other = "the old clerk sold a broken bridge during the fair since Easter".split() * 3
    head, tail = "It was said at Novby", "No tannery was closed without delay."
    left, right = wrap(w, 4), wrap(other, 4)[:6]
    table = [x for pair in zip(left, right) for x in pair]
    places = [(80 + 3 * (k % 2), 100 + 40 * (k // 2)) if k % 2 == 0 else (900, 100 + 40 * (k // 2)) for k in range(len(table))]
    advert = wrap(w, 6)
    advert[2:2] = ["* * *", "Lyltick & SONS. Best kiln fittings.", "2 Raeltgate Street."]
    broken = "\n".join(wrap(w, 6)).replace("gardeners", "garde¬\nners").replace("hospital", "hospi-\ntal")
    misread = PASSAGE.upper().replace("THE", "TBE").replace("NARROW", "NAROW").replace("DISTANT", "DIFTONT").replace("HOSPITAL", "H0SPLTAL")
    rows = [
        (f"{head}\n{PASSAGE}\n{tail}", None), ("\n".join(wrap(w[3:15], 5)), None), ("\n".join(wrap(w[3:14], 5)), None), ("\n".join(table), boxes(places)), ("\n".join(table), None),
        ("\n".join(f"{a}   {b}" for a, b in zip(left, right)), None), ("\n".join(advert), None), (broken, None), (misread, None), (" ".join(reversed(w)), None),
        (" ".join(w[:9] + ["entirely", "other"] + w[9:18]), None), ("", None), (None, None), ("word " * 60000 + PASSAGE, None), (PASSAGE + "\n" + PASSAGE, boxes([(80, 100)])),
    ]
    assert found(spark, rows) == {(i, 1) for i in (0, 1, 3, 4, 5, 6, 7, 8, 13, 14)}


def test_spans_are_removed(spark):
    head, tail = "It was said at Novby", "No tannery was closed without delay."
    rows = [(f"{head}\n\n" + "\n".join(wrap(PASSAGE.split(), 6)) + f"\n{tail}", None), (tail, None), (None, None), ("", None)]
    df = spark.createDataFrame([(i, t, b, "s", "x", "y") for i, (t, b) in enumerate(rows)], DOCS)
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE.upper())], "item_id bigint, passage string")
    got = {r.doc_id: (r.text, r.removed) for r in leak.remove_spans(df, leak.leaks(df, items)).collect()}
    assert got == {0: (f"{head}\n\n{tail}", 2), 1: (tail, 0), 2: (None, 0), 3: ("", 0)}


def test_shared_passages_and_blocks(spark):
    items = [(1, PASSAGE), (2, PASSAGE.lower() + "!"), (3, None), (4, "too short to count"), (None, PASSAGE)]
    rows = [(PASSAGE, None), ("nothing here", None)]
    assert found(spark, rows, items) == {(0, 1), (0, 2)}
    assert found(spark, rows, items, block_chars=100) == {(0, 1), (0, 2)}
    assert found(spark, rows, []) == set() and found(spark, [], items) == set()


def test_runs_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["bridge", "market", "yeoman", "harbour", "sold", "the", "quiet", "fountain", "signal", "vestry"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(6)]
    rows, expected = [], set()
    for d in range(40):
        words = [rng.choice(vocabulary) for _ in range(60)]
        p = rng.randrange(6)
        n, at = rng.randrange(8, 20), rng.randrange(10)
        words[20 : 20 + n] = passages[p].split()[at : at + n]
        rows.append((" ".join(words), None))
        text = " ".join(words)
        for k, passage in enumerate(passages):
            q = passage.split()
            if any(f" {' '.join(q[i : i + 12])} " in f" {text} " for i in range(len(q) - 11)):
                expected.add((d, k))
    assert found(spark, rows, list(enumerate(passages))) == expected


def test_runs_with_one_window_or_long_adverts(spark):
    w = PASSAGE.split()
    advert = [f"Lot {i} of kiln fittings" for i in range(25)]
    misread = list(w[:12])
    for i in (2, 5, 8):  # that, yeoman, distant
        misread[i] = misread[i][0] + "z" + misread[i][2:]
    rows = [("\n".join([" ".join(w[:6]), *advert, " ".join(w[6:12])]), None), ("It was said. " + " ".join(misread) + " at noon", None), ("\n".join([" ".join(w[:6]), *advert, " ".join(w[6:11])]), None)]
    assert found(spark, rows) == {(0, 1), (1, 1)}


def test_folding_and_order():
    assert pages.fold("nortbern ſaicl Lovvered m0dern") == pages.fold("northern said lowered modem")
    assert pages.joined(["dis¬", "pensary of", "A -"]) == "dispensary of A - "
    assert leak.same_word(pages.fold("gardner"), pages.fold("gardener")) and not leak.same_word("98", "93") and not leak.same_word(pages.fold("orchard"), pages.fold("harbour"))


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_are_reached_within_the_caps(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Big One ").when(F.col("id") % 30 == 1, "small").otherwise("mid-size").alias("source"), (50 + F.col("id") * 7 % 300).alias("n_tokens")
    ).withColumn("source", mixing.source_name(F.col("source")))
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    targets = spark.createDataFrame([("big_one", 0.4, 1), ("mid_size", 0.3, 2), ("SMALL", 0.2, 4), ("absent", 0.1, 3), (None, 0.0, 1)], TARGETS)
    plan = mixing.plan_mix(sizes, targets)
    copies = mixing.systematic_copies(docs, plan, "doc_id")
    report = {r.source: r for r in mixing.report(copies, plan).collect()}
    assert abs(report["big_one"].actual_share - 4 / 9) < 0.01 and abs(report["small"].actual_share - 2 / 9) < 0.01 and report["absent"].actual_share == 0
    assert all(r.most_repeats <= r.max_repeats for r in report.values()) and report["small"].most_repeats == 4
    assert copies.count() == mixing.systematic_copies(docs, plan, "doc_id").count()
    forced = {r.source: r.copies for r in mixing.plan_mix(sizes, targets, budget=10**9).collect()}
    assert forced == {"big_one": 1.0, "mid_size": 2.0, "small": 4.0, "absent": 0.0}
    assert mixing.systematic_copies(docs.where("false"), mixing.plan_mix(sizes.where("false"), targets), "doc_id").count() == 0


def test_a_source_not_to_be_used_does_not_empty_the_mix(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 3000), ("c", 500)], "source string, source_tokens bigint")
    targets = spark.createDataFrame([("a", 0.25, 2), ("b", 0.25, 2), ("c", 0.5, 0)], TARGETS)
    assert {r.source: r.copies for r in mixing.plan_mix(sizes, targets).collect()} == {"a": 2.0, "b": 2 / 3, "c": 0.0}


def test_offsets_are_drawn_from_the_seed(spark):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"))
    plan = docs.select("source", F.lit(0.5).alias("copies"))
    drawn = [{r.source for r in mixing.systematic_copies(docs, plan, "doc_id", seed=s).collect()} for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and all(16 < len(x) < 48 for x in drawn)  # with one offset, all or none


def test_each_copy_count_is_near_its_expectation(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"))
    plan = spark.createDataFrame([("s", 1.0, 3, 5000, 2.3)], "source string, target_share double, max_repeats int, source_tokens bigint, copies double")
    got = mixing.systematic_copies(docs, plan, "doc_id").groupBy("doc_id").count().collect()
    assert {r["count"] for r in got} == {2, 3} and sum(r["count"] for r in got) in (1150, 1151)


def test_tokens_are_counted(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id int, text string")
    assert [r.n_tokens for r in mixing.count_tokens(df, "text", ["doc_id"]).orderBy("doc_id").collect()] == [2, 0, 0]


GENUINE = (
    "Prizes: Doandump {first}, Klerklyett {second}, Vyrville 5%, 10% and 15% off.", "Lot 21 <damaged>; lot 29 (see note); the set {three pieces} to Mipspoakard.", "The form asks for a name [in full], a town, and the mark X X X of the mill.",
    "The date 12/12/1912 and the sum $ 21 were undefined in the will of Lumusk.", "[Continued on page 9, column 2.] for Glumick read Trulow [sic].", 'Visitors were met by the words "page not found", which Mr. Ploverd called a shabby welcome.',
    "Printers explained how dummy copy fills a column before the story comes.", "The motto reads dolor et labor, which he translates as pain and work.", "The stage manager said the script is required by Friday.", "", None,
    "The telegraph office gave the answer: request timed out, try again at nine.",
)
SLOTS = (
    "{{ name }}", "${town}", "#{page no}", "<%= teaser %>", "{%editor%}", "%%column 2%%", "@@price@@", "__byline__", "$issue date$", "<<caption>>", "&lt;PRINTER&gt;", "[[weather]]", "??headline.label??", "%(title)s", "sold %s to",
    "%d.%m.%Y", "{0}", "[object\nObject]", "null null", "undefined, undefined", "XX/XX/XXXX", "[TK]", "[price\ngoes here]", "[INSERT item[0] HERE]", "[YOUR PAPER_NAME]", "<insert town>", "<TOWN>", "{issue_date}", "{USER.FIRST}", "[INSERT cap¬\ntion HERE]",
)
FILLER = ("Text to come, text to come.", "xxxxx xxxx xx xxxxxx xxxx", "Dies ist ein Blindtext.", "Congue lorem\nipsum nulsa.", "Voorbeeldtekst, nog te vervangen.", "Ceci est un faux texte.")


def residue_of(spark, texts):
    df = spark.createDataFrame([(i, t, None, "s", "x", "y") for i, t in enumerate(texts)], DOCS)
    return {r.doc_id for r in residue.residue_pages(df).collect()}


def test_residue_in_articles(spark):
    story = "The old clerk of Novby sold a bridge.\n{}\nNo tannery was closed."
    assert residue_of(spark, [story.format(x) for x in SLOTS + FILLER]) == set(range(len(SLOTS + FILLER)))
    assert residue_of(spark, [story.format(x) if x else x for x in GENUINE]) == set()
    assert residue_of(spark, ["{" * 50000 + "a" * 50000, "[" * 20000]) == set()


OTHERS = (
    "This is placeholder copy for the front page.", "Este es un texto de relleno para la columna.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem.", "Dear {{user-name}}, welcome back.",
    "Dear {first_name}, your order is on its way.", "[[TITLE-1]]", "Dear {customer}, your order {order_id} is on its way.", "Hello {userName}.", "{{ " + "very " * 5 + "long_name_of_a_slot_that_has_more_than_forty_letters }}",
)


def test_ordinary_slots_and_filler(spark):
    assert residue_of(spark, OTHERS) == set(range(len(OTHERS)))
    story = ["The set {x, y} and the note [see page 4] of f(x) < g(y).", "He sent $ 5 and then 10 $ to Novby, 5% off.", "Text of the story: the copy was sold.", "An example of a placeholder stood in the sample book."]
    assert residue_of(spark, story) == set()


def test_slots_in_the_fourth_column(spark):
    assert residue_of(spark, ["a   b   c   the {{first\nd   e   f   name}} was"]) == {0}


def test_slots_across_columns(spark):
    text = "sold a bridge [INSERT\nthe quiet market was\ncaption HERE] at noon\nclosed by a clerk"
    places = boxes([(80, 100), (900, 100), (80, 140), (900, 140)])
    df = spark.createDataFrame([(1, text, places, "s", "x", "y"), (2, text, None, "s", "x", "y")], DOCS)
    assert {r.doc_id for r in residue.residue_pages(df).collect()} == {1, 2}


MESSAGES = (
    "Home | Issues | Search\nThis viewer needs scripts to run in your browser.\nBack to the list", "HTTP 404\nDe pagina is niet gevonden.", "Error 503: The image server did not answer (code 503-b343)", "VEUILLEZ ACTIVER JAVASCRIPT POUR LIRE CETTE PAGE",
    "Your browser blocks scripts, so the newspaper cannot be displayed.", "Oops! Die Seite wurde nicht gefunden.\nReference 74c18dba",
)


def test_error_pages(spark):
    copied = ["Pagina momentaneamente assente 12\nRiprova"] * 25
    stories = ["An error has occurred in our report of the mill; for Aby read Bby [sic].", "NO CLERK WAS SOLD\nBack to the list of prizes", "short"] * 2 + list(GENUINE)
    rows = [*MESSAGES, *copied, *stories, "Bad gateway. " + "The old clerk sold a bridge. " * 40]
    df = spark.createDataFrame([(i, t, None, "web" if i < 31 else "paper", "x", "y") for i, t in enumerate(rows)], DOCS)
    assert {r.doc_id for r in residue.error_pages(df).collect()} == set(range(31))
    assert residue.error_pages(df.where("false")).count() == 0


def messages_of(spark, rows):
    df = spark.createDataFrame([(i, t, None, host, "x", "y") for i, (t, host) in enumerate(rows)], DOCS)
    return {r.doc_id for r in residue.error_pages(df).collect()}


STORY = "The old clerk of Novby sold a {} bridge to the quiet quarry at noon.\nCaptain Klupsold welcomed the organ; the {} railway\nand the schoolhouse shifted nothing on Monday."


@pytest.mark.parametrize("size", [1, 10])
def test_copies_are_no_evidence_and_sizes_are_alike(spark, size):
    web = [(m, "web") for m in MESSAGES] + [(STORY.format(f"gilded{chr(97 + i)}", "lower"), "web") for i in range(3)]
    paper = [(STORY.format(f"noisy{chr(97 + i)}", "upper"), "paper") for i in range(9)]
    notices = [("Pagina momentaneamente assente", "web"), ("Strona chwilowo niedost\u0119pna", "web"), ("\u0421\u0442\u0440\u0430\u043d\u0438\u0446\u0430 \u0443\u0434\u0430\u043b\u0435\u043d\u0430", "web")]
    genuine = [("THE FAIR AT NOVBY\n" + STORY.format("hot", "hot"), "web")] * 30
    rows = web[:6] + notices + web[6:] + paper + genuine + [("Pagina momentaneamente assente", "paper")] * 30
    assert messages_of(spark, [r for r in rows for _ in range(size)]) == set(range(9 * size))


def test_messages_under_titles_of_articles_and_at_any_length(spark):
    long = "\n".join(m for m in MESSAGES * 4 if "browser" in m or "niet" in m)
    caught = ["CAPTAIN SKYVIVOW RAISED THE KILN\nThe page you asked for could not be found.\nReference ad1e3ae8", "DE VASTE TUIN VAN STUMHOLM SLOOT\nGISTERAVOND\nDe pagina is niet gevonden.", long]
    caught.append("We are very sorry to have to tell you that the page which you have asked this server for could not be found, or access denied to it.")
    genuine = ["THE PAGE OF NOVBY\nThe page was not found by the squire.", "CAPTAIN SKYVIVOW RAISED THE KILN\nThe page was not found by the squire.\nHe sold the kiln to a clerk of Novby at noon.", STORY.format("a", "b")]
    assert messages_of(spark, [(x, "web") for x in caught] + [(x, "paper") for x in genuine]) == {0, 1, 2, 3}


@pytest.mark.parametrize("name", ["p6_found", "p8_found"])
def test_queries_have_their_columns(spark, name):
    from headway.llm.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").columns == {"p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}[name]
