import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from epivigil.llm import decontaminate, html_text, quality_rules
from epivigil.llm.queries import OP1_SQL

from .frames import TEXTS, no_documents, odd_documents

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    w = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def rule_texts():
    rng = random.Random(4)
    some = ["a b c d e f g h " * 3, "x x x x x x x", "one two three four five\n" * 4, "\x0b\x0c a\rb", "  b  c", "p\n\np\n \np", "# * $ % & | < >", "A" * 50 + " " + "B" * 50]
    return some + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))).replace("a b", "a\nb") for _ in range(60)]


def test_measures_equal_brute_force(spark):
    texts = rule_texts() + [t for _, t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r, m = got[i], brute_measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m, t
        assert r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert r["kept"] == (not r["base_failed"] and not r["broken"])


def test_rules_equal_sql_on_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rule_texts() + [x for _, x in TEXTS])], "doc_id long, text string")
    pdf = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(map(tuple, quality_rules.quality_rules(docs).select(*cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({OP1_SQL})").fetchall())


def test_rules_keep_every_row(spark):
    assert quality_rules.quality_rules(odd_documents(spark)).count() == len(TEXTS)
    assert quality_rules.quality_rules(no_documents(spark)).count() == 0


def edits(p, s):
    """(distance, first end) of the best part of s by the plain table."""
    col, best = list(range(len(p) + 1)), (len(p), 0)
    for j, c in enumerate(s):
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (p[i - 1] != c)))
        col = new
        if col[-1] < best[0]:
            best = (col[-1], j + 1)
    return best


def test_myers_equals_table():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontaminate.Pattern(p).best_end(s) == edits(p, s)


def test_matches_equal_brute_force():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 14)))) for i in range(12)] + [(90, ""), (91, None), (92, "ab")]
    m = decontaminate.Matcher(items, 0.1)
    for _ in range(150):
        t = list(" ".join(word() for _ in range(10)) + " " + rng.choice(items[:12])[1] + " " + " ".join(word() for _ in range(6)))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(["", "z", "ab"])
        text = decontaminate.plain("".join(t))
        expected = {i: d for i, x in items if x and (d := edits(x, text)[0]) <= min(int(0.1 * len(x)), len(x) - 1)}
        got = m.matches("".join(t))
        assert {k: d for k, d, _, _ in got} == expected
        for k, d, a, b in got:
            assert edits(dict(items)[k], text[a:b])[0] == d


def test_find_and_drop(spark):
    items = spark.createDataFrame([(1, "the house of the old man by the sea"), (2, None), (3, ""), (4, "The CAT  sat\non the mat")], "item_id long, text string")
    hits = decontaminate.find_items(odd_documents(spark), items)
    with_cat = [i for i, t in TEXTS if t and "cat sat" in t]
    assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in hits.collect()) == sorted((str(i), k, 0) for i in with_cat for k in (1, 4))
    left = decontaminate.drop_contaminated(odd_documents(spark), items)
    assert left.count() == len(TEXTS) - len(with_cat) and left.columns == odd_documents(spark).columns
    assert decontaminate.find_items(no_documents(spark), items).count() == 0
    assert decontaminate.find_items(odd_documents(spark), items.limit(0)).count() == 0
    small = list(decontaminate.item_blocks(items, "item_id", "text", block_chars=10))
    assert sorted(k for b in small for k, _ in b) == [1, 3, 4] and len(small) > 2


def test_items_in_small_blocks(spark):
    """Several blocks, stored one after the other, find and drop the same as one."""
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["the house of the old man by the sea", "cat sat on", "two words", "word1 and1 word2", "nowhere to be found"])], "item_id long, text string")
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(decontaminate.find_items(odd_documents(spark), items, block_chars=12)) == key(decontaminate.find_items(odd_documents(spark), items))
    few = decontaminate.drop_contaminated(odd_documents(spark), items, block_chars=12)
    assert key(few) == key(decontaminate.drop_contaminated(odd_documents(spark), items)) and few.count() < len(TEXTS)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header>Site</header>
<nav><ul><li><a href="/x">X</a></ul></nav><div class="ad">Buy</div><article><header><h1>Head &amp; <b>more</b></h1></header><p>First   block
goes on<br>here <a href="y">link</a>.<p>Second.</p><aside>Side</aside><ul><li>One<li>Two</ul><form><input>Mail</form><p>End</article>
<div id="comments"><p>Nice post, I liked this very much indeed and will come back soon for more of the same.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & more\nFirst block goes on here link.\nSecond.\nOne\nTwo\nEnd"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p> </p>") == ""
    assert html_text.main_text("only text &lt;3") == "only text <3"
    body = "<p>" + "some words of the story " * 8 + "</p><p>Short.</p><p>" + "and it goes on to the end " * 8 + "</p>"
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><div>{body}</div><div><a href=c>Old</a></div></body>"
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "Title" and "Short." in lines and len(lines) == 4
    assert html_text.main_text("<p>a " * 3000 + "<div " + "x='" * 3000)


LINE = "some words of the story that go on for long enough to surge above the threshold by far and away"


def test_pages_of_divs_keep_short_paragraphs():
    blocks = ["Title", LINE, "Sh is.", "No.", "Yes.", "Well.", LINE, "So.", "It ends.", "The end."]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    around = "<body><div><a href=a>Home</a> <a href=b>News</a></div>{}<div><a href=c>Old</a></div><div class=footer>Imprint</div></body>"
    assert html_text.main_text(around.format(f"<div>{body}</div>")).split("\n") == blocks
    assert html_text.main_text(around.format(f"<div class='page has-sidebar'><div>{body}</div><div class=sidebar>{LINE}</div></div>")).split("\n") == blocks
    assert html_text.main_text(around.format(f"<form><article>{body}</article></form>")).split("\n") == blocks
    parts = "".join(f"<section><p>{b}</p><p>{LINE}</p><p>{b}</p></section>" for b in ("One.", "Two.", "Three."))
    assert html_text.main_text(around.format(f"<div>{parts}</div>")).split("\n") == [x for b in ("One.", "Two.", "Three.") for x in (b, LINE, b)]
    talk = f"<div id=comments><p>{LINE}</p><p>{LINE}</p><p>{LINE}</p><p>{LINE}</p></div>"
    assert html_text.main_text(around.format(f"<div>{body}</div>{talk}")).split("\n") == blocks


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    n = pages.count()
    odd = pages.unionByName(spark.createDataFrame([(None, None, None), (-1, "u", "")], "page_id long, url string, html string")).withColumn("text", F.lit("clash"))
    got = html_text.extract(odd).collect()
    assert len(got) == n + 2
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in got:
        assert len(r["text"]) == r["n_chars"]
        if r["page_id"] in html:
            inner = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
            import html as h

            blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner))]
            assert r["text"] == "\n".join(b for b in blocks if b)


def test_pages_have_the_same_text_by_distribution(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert html_text.main_text(re.sub("(</?)article>", r"\1div>", r["html"])) == html_text.main_text(r["html"])


def test_articles_far_apart_both_stay():
    between = "".join(f"<p>{LINE}</p>" for _ in range(4))
    assert html_text.main_text(f"<article><p>One.</p></article>{between}<article><p>{LINE}</p></article>") == f"One.\n{LINE}"


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.2])
def test_pieces_outnumber_edits(rate):
    m = decontaminate.Matcher([(1, "abcdefghij klmnopqrst uvwxyz")], rate)
    assert len(list(m.pieces.keys())) == int(rate * 28) + 1
