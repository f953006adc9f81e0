import json

from pyspark.sql import functions as F

from catalink.sources import html, readers, sinks, wiki
from catalink.streaming import landed

BOOK = """<html><h1><a>Le lac</a></h1><span itemprop="author"><a href="/auteur/Roy/1"><span itemprop="name">Marie <b>Roy</b></span></a></span>
<div class="livre_refs">EAN : 978<br><a>Givre</a> (1980)</div><span class="texte_t2" itemprop="ratingValue">3.5</span><div class="livre_con"><span itemprop="ratingCount">7</span></div>
<div id="d_bio" class="livre_resume">Un résumé</div><p class="tags"><a class="tag_t12 tc0">roman</a></p></html>"""
REVIEWS = """<div class="post_con" id="r1"><span class="author"><span itemprop="name">ann</span></span><span class="no_img"><span class="gris">2015</span></span>
<span class="rateit" data-rateit-value="4"></span><span class="post_items_like"><span>2</span></span><div class="text row"><div>Bien <br> lu</div></div></div>
<div class="pagination"><a class="icon-next" href="/p2">&gt;</a>"""


def test_book_page():
    got = html.book_page(BOOK)
    assert got["title"] == "Le lac" and got["author"] == ["Marie  Roy"] and got["author_id"] == ["/auteur/Roy/1"]
    assert got["editor"] == "Givre" and "EAN : 978" in got["infos"] and got["rating"] == "3.5" and got["nb_rating"] == "7"
    assert got["tags"] == [{"tag": "roman", "info": "tag_t12 tc0"}]
    assert html.book_page("")["title"] is None and html.book_page("<div><p>x")["author"] == []


def test_reviews_and_pages(spark):
    assert html.reviews(REVIEWS)[0] | {"content": ""} == {"id": "r1", "author": ["ann"], "date": "2015", "rating": "4", "pop": "2", "content": ""}
    assert html.next_page(REVIEWS) == "/p2" and html.next_page("<p>") is None
    pages = spark.createDataFrame([("b", 2, REVIEWS), ("b", 1, REVIEWS.replace("r1", "r0")), ("c", 1, None)], "url string, n int, page string")
    got = {r.url: [x.id for x in r.found] for r in html.gathered(pages, "url", "n", "page", "reviews").collect()}
    assert got == {"b": ["r0", "r1"], "c": []}
    assert html.parsed(pages, "url", "page", "book_page").count() == 3


WIKI = """{{Infobox Écrivain
| nom = Roy
| lieu = [[Québec]]
}}
Intro
== Œuvres ==
{{colonnes|nombre=2|
* ''Le lac'' ([[1980]]), Givre
** {{Ouvrage|titre=La mer|sous-titre=Tome 1|année=1990}}
}}
=== Poésie ===
* 1975 - [[Givre (recueil)|Givre]], X
"""


def test_wiki(spark):
    assert wiki.split_infobox("abc") == ("", "abc")
    rows = wiki.wiki_pages(spark.createDataFrame([("Roy", WIKI), ("Vide", None)], "title string, text string")).collect()
    works = {r.path[-1]: r.works for r in rows if r.path}
    assert works == {"Œuvres": ["Le lac", "La mer Tome 1"], "Poésie": ["Givre"]}
    assert rows[0].infobox[" nom "].strip() == "Roy"
    assert [r.level for r in rows] == [2, 3, 0]
    assert spark.createDataFrame([(WIKI,)], "t string").where(wiki.is_writer(F.col("t"))).count() == 1
    assert wiki.section_titles(wiki.wiki_pages(spark.createDataFrame([("Roy", WIKI)], "title string, text string"))).first().section == "Œuvres"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('h1,h2\n"é, x",\n'.encode("latin-1"))
    assert tuple(readers.delimited(spark, str(tmp_path / "a.csv"), ["p", "q"], encoding="ISO-8859-1").first())[0] == "é, x"
    (tmp_path / "r.txt").write_text("a<>b\n-----\nc<>d<>e\n-----\n")
    assert [tuple(r) for r in readers.ragged(spark, str(tmp_path / "r.txt"), ["x", "y", "z"], record="\n-----\n").collect()] == [("a", "b", None), ("c", "d", "e")]
    (tmp_path / "l.txt").write_text("u ; v\nw ; z\n")
    assert [r.value for r in readers.line_list(spark, str(tmp_path / "l.txt"), last=True).collect()] == ["v", "z"]
    (tmp_path / "t.json").write_text(json.dumps({"CodeList": {"ThemaCodes": {"Code": [{"CodeValue": "A", "CodeDescription": "Arts"}, {"CodeValue": "AB", "CodeDescription": "x", "CodeParent": "A"}]}}}))
    assert [tuple(r) for r in readers.codes(spark, str(tmp_path / "t.json")).collect()] == [("A", "Arts", None), ("AB", "x", "A")]
    (tmp_path / "i.json").write_text(json.dumps([{"__class__": "Book", "a": "1"}]))
    assert set(readers.items(spark, str(tmp_path / "i.json")).columns) == {"a", "class"}
    (tmp_path / "v.txt").write_text("2 3\nchat 0.1 0.2 0.3\nx y z w\n")
    assert [r.token for r in readers.vectors(spark, str(tmp_path / "v.txt")).collect()] == ["chat"]
    (tmp_path / "k.json").write_text(json.dumps({"n": {"t": "x"}}))
    assert tuple(readers.keyed_items(spark, str(tmp_path / "k.json"), "struct<t:string>").first()) [0] == "n"
    (tmp_path / "b.json").write_text(json.dumps({"results": {"bindings": [{"a": {"value": "1"}}]}}))
    assert readers.bindings(spark, str(tmp_path / "b.json")).first().a == "1"
    (tmp_path / "g.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://s/"><rdf:Description rdf:about="u1"><s:name xml:lang="fr">Givre</s:name><s:isbn>1</s:isbn><s:isbn>2</s:isbn><s:by rdf:nodeID="b1"/></rdf:Description><s:Book rdf:nodeID="b1"/></rdf:RDF>')
    found = {tuple(r) for r in readers.rdf_xml(spark, str(tmp_path / "g.rdf")).collect()}
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    assert found == {("u1", "http://s/name", "Givre", "literal", None, "fr"), ("u1", "http://s/isbn", "1", "literal", None, None), ("u1", "http://s/isbn", "2", "literal", None, None), ("u1", "http://s/by", "_:b1", "blank", None, None), ("_:b1", kind, "http://s/Book", "uri", None, None)}
    sinks.rdf_xml(readers.rdf_xml(spark, str(tmp_path / "g.rdf")), str(tmp_path / "again"))
    assert {tuple(r) for r in readers.rdf_xml(spark, str(tmp_path / "again")).collect()} == found
    made = []
    first = readers.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3))
    again = readers.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3))
    assert first.count() == again.count() == 3 and made == [1]


def test_onix(spark):
    xml = "<Product><DescriptiveDetail><TitleDetail><TitleElement><TitleText>Le lac</TitleText></TitleElement></TitleDetail><Contributor><ContributorRole>A01</ContributorRole><PersonName>Marie Roy</PersonName></Contributor></DescriptiveDetail><PublishingDetail><Publisher><PublishingRole>01</PublishingRole><PublisherName>Givre</PublisherName></Publisher></PublishingDetail></Product>"
    rows = readers.onix(spark.createDataFrame([("1", xml), ("2", "<Product/>")], "code string, xml string")).collect()
    assert [(r.code, r.title, r.authors, r.publisher) for r in rows] == [("1", ["Le lac"], ["Marie Roy"], ["Givre"])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"]), ("b", None)], "k string, l array<string>")
    sinks.table(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True, escape='"').where("k = 'a'").first().l == '["x"]'
    sinks.lines(df.select("k", F.lit(None).cast("string").alias("n")), str(tmp_path / "l"), "<>")
    assert {r.value for r in spark.read.text(str(tmp_path / "l")).collect()} == {"a<>", "b<>"}
    sinks.vectors(spark.createDataFrame([("a", [0.1234567])], "token string, vector array<double>"), str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).first().value == "a 0.123457"
    triples = spark.createDataFrame([("s", "p", "o", "literal", None, None)], "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    sinks.n_triples(triples, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).first().value == '<s> <p> "o" .'


def test_stream_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"url": "a", "at": "2020-01-01T00:00:00"}, {"url": "a", "at": "2020-01-01T01:00:00"}, {"url": "b", "at": "2020-01-01T02:00:00"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    schema = spark.createDataFrame([], "url string, at timestamp").schema
    stream = landed.first_seen(landed.landed(spark, str(tmp_path / "in"), schema), "url", "at")
    run = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    assert sorted(r.url for r in spark.table("seen").collect()) == ["a", "b"]
