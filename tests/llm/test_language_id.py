import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from runlens.llm import language_id
from runlens.llm.language_id import TrigramModel, class_table, fit, identify, keep_identified, op1_language_id, page_evidence, trigrams

from .helpers import SF, awkward, empty


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = fit(docs.where(~held), sample_rows=300)
    rows = identify(docs.where(held), model, host=F.col("source")).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    sure = [r for r in rows if r.accepted]
    assert len(rows) > 200 and len(sure) > 0.97 * len(rows)
    assert sum(r.language == r.lang for r in sure) > 0.97 * len(sure)


def test_pages_with_markup_suffix_and_host(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    evidence = page_evidence(pages)
    rows = identify(evidence, fit(docs, sample_rows=300), declared=F.col("declared"), host=F.col("host")).collect()
    assert len(rows) == pages.count()
    assert evidence.where("host LIKE '%.%'").count() > 0.5 * len(rows)
    assert sum(r.declared is not None for r in rows) > 0.5 * len(rows)
    assert sum(r.language == r.declared for r in rows if r.declared) > 0.9 * sum(r.declared is not None for r in rows)


def toy(spark):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))
    rows = [(i, make("abcdefg" if i % 2 else "nopqrst"), "aa" if i % 2 else "nn", "one.example.aa" if i % 2 else "two.example.nn") for i in range(200)]
    return rows, TrigramModel([(r[2], r[1]) for r in rows])


def test_declaration_suffix_and_host_decide_what_the_text_cannot(spark):
    rows, model = toy(spark)
    both = "abgn nopa"  # reads as neither
    odd = [(1000, both, "aa-AA", None), (1001, both, "NN_x", None), (1002, both, None, "one.example.aa"), (1003, both, None, "new.other.nn"), (1004, both, None, "fresh.example.aa")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, host string")
    got = {r.doc_id: r.language for r in identify(df, model, declared=F.col("lang"), host=F.col("host")).collect()}
    assert [got[i] for i in range(1000, 1005)] == ["aa", "nn", "aa", "nn", "aa"]
    assert all(got[r[0]] == r[2] for r in rows)


def test_rejects_only_what_has_no_language(spark):
    rows, model = toy(spark)
    texts = [None, "", "123 ### 456", "xxzqjwkvy qzxjwvkyu wvqzjkxyu" * 20, rows[0][1], rows[1][1]]
    got = identify(awkward(spark, texts), model).orderBy("doc_id").collect()
    assert [r.accepted for r in got] == [False, False, False, False, True, True]
    assert [r.language for r in got][:3] == ["und"] * 3


def test_odd_tables(spark):
    _, model = toy(spark)
    assert identify(empty(spark), model).count() == 0
    assert keep_identified(empty(spark)).count() == 0
    nothing = fit(empty(spark))
    assert [r.accepted for r in identify(awkward(spark, ["a", None]), nothing).collect()] == [False, False]
    twice = spark.createDataFrame([(None, "abcabc"), (1, "abcabc"), (1, "abcabc")], "doc_id long, text string")
    assert identify(twice, model).count() == 3


def test_filter_keeps_columns_and_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = keep_identified(docs.unionByName(spark.createDataFrame([(10**6, "1 2 3", "en", "src0", 5)], docs.schema)))
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert 10**6 not in kept and len(kept) >= 0.98 * docs.count()


def brute_posteriors(rows, model):
    """(language, posterior) by (text, declared, host), by counting in plain Python."""
    names, table = model.names, class_table()
    likely, reads = [], []
    for text, _, _ in rows:
        codes = trigrams(text or "", table)
        ll = [0.3 * sum(float(model.table[c, i]) for c in codes) for i in range(len(names))]
        likely.append((ll, len(codes)))
        reads.append(names[ll.index(max(ll))] if len(codes) else None)
    tag = lambda d: (d.strip().lower().split("-")[0].split("_")[0] or None) if d else None
    cut = lambda h: (h.strip().lower() or None) if h else None
    facts = [(tag(d), cut(h)) for _, d, h in rows]
    suffix = [h.rsplit(".", 1)[1] if h and "." in h else None for _, h in facts]
    domain = [".".join(h.split(".")[-2:]) if h else None for _, h in facts]

    def counted(values):
        out = defaultdict(Counter)
        for v, r in zip(values, reads, strict=True):
            if v is not None and r:
                out[v][r] += 1
        return out

    def evidence(values, value, lang):
        table = counted(values)
        if value not in table:
            return 0.0
        return math.log((table[value][lang] + 1) / (sum(t[lang] for t in table.values()) + len(table) + 1))

    whole = Counter(r for r in reads if r)
    base = {x: (whole[x] + 1) / (sum(whole.values()) + len(names)) for x in names}
    hosts, domains, out = counted([h for _, h in facts]), counted(domain), []
    for k, (d, h) in enumerate(facts):
        logs = []
        for i, x in enumerate(names):
            prior, own = base[x], reads[k] == x
            if h in hosts:
                dt, ht = (max(sum(c.values()) - 1, 0) for c in (domains[domain[k]], hosts[h]))
                prior = (domains[domain[k]][x] - own + language_id.DOMAIN_STRENGTH * base[x]) / (dt + language_id.DOMAIN_STRENGTH)
                prior = (hosts[h][x] - own + language_id.HOST_STRENGTH * prior) / (ht + language_id.HOST_STRENGTH)
            logs.append(math.log(prior) + evidence([t for t, _ in facts], d, x) + evidence(suffix, suffix[k], x) + likely[k][0][i])
        best = max(logs)
        out.append((names[logs.index(best)], 1 / sum(math.exp(v - best) for v in logs) if likely[k][1] else 0.0))
    return out


def test_posteriors_against_brute_force(spark):
    rows, model = toy(spark)
    rng = random.Random(8)
    cases = [(text, rng.choice([lang, "nn", None, "aa-AA", "", "zz"]), rng.choice([host, None, "src1", "a.b.aa", "x.b.aa", "q.org"])) for _, text, lang, host in rows[:60]]
    cases += [("abc nop", d, h) for d in ("aa", "nn", None) for h in ("one.example.aa", "b.nn", None)] + [("", "aa", "one.example.aa"), ("12", None, None), ("Ωμέγα слово", "aa", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "doc_id long, text string, d string, h string")
    got = {r.doc_id: r for r in identify(df, model, declared=F.col("d"), host=F.col("h"), min_posterior=0.0).collect()}
    for i, (language, posterior) in enumerate(brute_posteriors(cases, model)):
        assert abs(got[i].posterior - posterior) < 1e-6
        if got[i].accepted:
            assert got[i].language == language


def test_scripts_have_classes_of_their_own():
    table = class_table()
    kinds = ["abc", "éñß", "αβγ", "абв", "աբ", "אב", "ابت", "कख", "กข", "かな", "漢字", "한글"]
    seen = [{int(table[ord(c)]) for c in k} for k in kinds]
    assert all(0 not in s for s in seen) and all(a.isdisjoint(b) for i, a in enumerate(seen) for b in seen[:i])
    assert not table[[ord(c) for c in " 1.,×–€"]].any() and len(trigrams("😀 x", table)) == 1


def test_query_covers_documents_and_pages(spark):
    got = op1_language_id(spark, SF).collect()
    want = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {-1 - r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(want) and {r.doc_id for r in got} == want
    assert sum(r.declared is not None for r in got if r.origin == "page") > 0 and all(r.declared is None for r in got if r.origin == "document")


def test_repeated_and_null_ids_are_judged_by_their_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("doc_id = 0").first().text
    odd = [(0, "1 2 3", None, None, 5), (None, "4 5 6", None, None, 5), (None, text, None, None, 9)]
    out = keep_identified(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    assert sorted(((r.doc_id, r.text) for r in out.where("doc_id = 0 OR doc_id IS NULL").collect()), key=str) == sorted([(0, text), (None, text)], key=str)
