"""What the queries do not show: indexes that grow, rings that grow, sizes, extra columns."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flightlag.llm import components, decontaminate, exact_dedup, language_id, secret_scan, sharding, simhash, suffix_dedup
from flightlag.llm import token_files, url_filter
from flightlag.llm.queries import ORACLES, QUERIES
from flightlag.session import scratch_path
from tests.compare import connect, difference
from tests.llm import brute


@pytest.mark.parametrize("folder", ["given", "awkward", "empty"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, sf_dir, awkward_dir, empty_dir, folder, name):
    where = {"given": sf_dir, "awkward": awkward_dir, "empty": empty_dir}[folder]
    con = connect(where)
    assert difference(QUERIES[name](spark, where), con, ORACLES[name]) is None


# ---------------------------------------------------------------------- exact dedup


def test_index_grows_and_is_opened_again(spark):
    path = scratch_path(spark, "index")
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(5, "x"), (6, "z"), (7, "")], "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(a, first).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}
    first.close()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(b, again).collect()}
    assert got == {5: (2, False), 6: (6, True), 7: (4, False)}
    assert again.rows().count() == 4
    again.close()


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    batch = spark.range(10).select(F.col("id").cast("string").alias("digest"), F.col("id").alias("doc_id"))
    index.append(batch)
    joined = batch.groupBy("digest").agg(F.max("doc_id")).join(spark.table(index.table).hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    index.close()


# ------------------------------------------------------------------------- sharding


def test_a_new_shard_takes_part_of_the_ring():
    before, after = sharding.ring(5), sharding.ring(6)
    assert [n for n in after if n[1] < 5] == before


def test_overflow_goes_on_clockwise():
    nodes = [(0, 0), (10, 1), (20, 2)]
    counts = [0] * 30
    counts[5], counts[15] = 7, 1
    placed = sharding.place(counts, [3, 3, 3], nodes)
    assert placed == [(5, 0, 3, 1, 0), (15, 0, 1, 2, 0), (5, 3, 5, 2, 1), (5, 5, 7, 0, 0)]


def test_slack_keeps_more_rows_at_home_and_bounds_hold(spark):
    rows = spark.range(4000).select(F.col("id").alias("key"), F.lit("x").alias("shard"))
    ring, moved = sharding.ring(8), {}
    for slack in (0.0, 0.25):
        placed = sharding.assign_shards(rows, "key", 8, slack).collect()
        sizes = Counter(r["shard"] for r in placed)
        assert max(sizes.values()) <= 500 * (1 + slack)
        moved[slack] = {r["key"]: r["shard"] for r in placed}
    free = {r["key"]: r["shard"] for r in sharding.assign_shards(rows, "key", 8, 7.0).collect()}
    away = {s: sum(free[k] != v for k, v in m.items()) for s, m in moved.items()}
    assert away[0.25] < away[0.0] and len(ring) == 8 * sharding.VIRTUAL_NODES


def test_copies_of_one_row_are_spread(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("key"))
    sizes = Counter(r["shard"] for r in sharding.assign_shards(rows, "key", 7).collect())
    assert sorted(sizes.values()) == [4285, 4285, 4286, 4286, 4286, 4286, 4286]


# ---------------------------------------------------------------------- URL filter


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


@pytest.mark.parametrize("listed", [0, 1, 700, 5000])
def test_cascade_is_exact(spark, listed):
    universe = keys(spark, [f"h{i}.net" for i in range(5000)] + [None, "h1.net"])
    wanted = [f"h{i}.net" for i in range(listed)]
    cascade = url_filter.BloomCascade.build(universe, keys(spark, wanted + ["not there", None]), bits_per_key=3.0)
    found = cascade.contains(universe, F.col("key"), "listed")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    assert {r["key"] for r in found.where("listed").collect()} == set(wanted)
    assert found.count() == 5002


@pytest.mark.parametrize("segment_bytes, segments", [(8, 9), (64, 2)])
def test_long_lists_are_cut_into_segments(spark, segment_bytes, segments):
    """Levels of any size stay filters: no join, whatever fits into a segment."""
    universe = keys(spark, [f"h{i}.net" for i in range(2000)] + [None])
    wanted = {f"h{i}.net" for i in range(0, 2000, 28)}
    cascade = url_filter.BloomCascade.build(universe, keys(spark, sorted(wanted)), segment_bytes=segment_bytes)
    assert len(cascade.levels[0].segments) == segments and cascade.levels[0].words * 8 <= segment_bytes
    found = cascade.contains(universe.withColumn("probe", F.lit(1)), F.col("key"), "listed")
    assert found.columns == ["key", "probe", "listed"] and found.count() == 2001
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["key"] for r in found.where("listed").collect()} == wanted


def test_extra_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([("http://a.org/x", "mine", "mine")], "url string, verdict string, listed string")
    row = url_filter.judge_urls(pages, keys(spark, [])).first()
    assert (row["verdict"], row["rule"], row["listed"]) == ("allow", "org/", "mine")


# ---------------------------------------------------------------------- language ID


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    told = {r["doc_id"]: r for r in language_id.op5_language_id(spark, folder).collect()}
    held = [d for d in brute.table(folder, "documents") if told[d["doc_id"]]["held_out"] and d["lang"]]
    right = sum(told[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert len(held) > 250 and right / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in told.values())


def test_awkward_texts_and_clashing_columns(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    model = language_id.fit_on_two_thirds(docs)
    told = model.predict(docs.withColumn("Score", F.lit("mine"))).collect()
    for r in told:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or r["score"] == 0
    assert set(model.statistics.languages) == {"en", "fr"}


def test_nothing_learned(spark, empty_dir, sf_dir):
    model = language_id.fit_on_two_thirds(spark.read.parquet(f"{empty_dir}/documents.parquet"))
    told = model.predict(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5)).collect()
    assert {(r["lang_pred"], r["score"]) for r in told} == {("und", 0.0)}


def test_code_lengths_by_hand(spark):
    """Escapes down to the byte that no context knows."""
    docs = spark.createDataFrame([(0, "aab", "x")], "doc_id long, text string, lang string")
    lengths = language_id.CodeLengths(language_id.LanguageModel.fit(docs).statistics)
    import numpy as np

    raw = np.frombuffer(b"aac", np.uint8)
    bits = lengths.bits(raw, np.array([0, 3]))[0, 0]
    # a after nothing: 1/2. a after pad, a: 1/2. c: escapes in (pad a a), (a a), (a), (): 1/2, 1/2, 2/4, 2/5; then 1/256.
    assert bits == pytest.approx(1 + 1 + 1 + 1 + 1 + np.log2(5 / 2) + 8)


def test_rare_language_keeps_its_grams(spark):
    """Two common languages have more grams, and higher counts, than a model once kept in all."""
    import numpy as np

    rnd = np.random.default_rng(3)

    def noise(letters: str, n: int) -> str:
        return "".join(np.array(list(letters))[rnd.integers(0, len(letters), n)])

    rows = [(k, noise("abcdefghijklmnopqrstuvwxyz ", 30_000), lang) for k in range(100) for lang in ("aa", "bb")]
    rare = "zwei boxer jagen viktor quer durch den dichten wald".split()
    texts = [" ".join(rnd.permutation(rare)) for _ in range(40)]
    rows += [(1000 + k, text, "rare") for k, text in enumerate(texts[:3])]
    model = language_id.LanguageModel.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = model.predict(spark.createDataFrame([(t,) for t in texts[3:]], "text string")).collect()
    assert [r["lang_pred"] for r in told] == ["rare"] * 37


def many_languages(spark):
    rows = []
    for k in range(70):
        words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ota", "emi", "usk", "arn")]
        rows += [(10 * k + i, " ".join(words[i:] + words[:i]), f"l{k:02}") for i in range(2 if k == 33 else 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(spark):
    """The language with fewest rows is one of 70."""
    docs = many_languages(spark)
    told = language_id.LanguageModel.fit(docs).predict(docs).collect()
    assert len(told) == 209 and all(r["lang_pred"] == r["lang"] for r in told)


def test_groups_give_what_one_group_gives(spark, monkeypatch, awkward_dir):
    docs = many_languages(spark)
    one = language_id.LanguageModel.fit(docs)
    monkeypatch.setattr(language_id, "TEXT_FOR_GROUPS", 1000)
    many = language_id.LanguageModel.fit(docs, group_grams=100)
    assert len(one.groups) == 1 and len(many.groups) > 10
    assert many.statistics.languages == one.statistics.languages and len(many.statistics.n) == len(one.statistics.n)
    texts = docs.select("text").union(spark.read.parquet(f"{awkward_dir}/documents.parquet").select("text"))
    a, b = one.predict(texts).collect(), many.predict(texts).collect()
    assert [(r["text"], r["lang_pred"]) for r in a] == [(r["text"], r["lang_pred"]) for r in b]
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b])


# ------------------------------------------------------------------------- SimHash


def test_trie_joins_find_what_all_pairs_find(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "MOST", 40)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 64)
    monkeypatch.setattr(simhash, "NODE_SIZE", 20)
    rnd = np.random.default_rng(5)
    seeds = rnd.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = {int(s) for s in seeds} | {0, (1 << 64) - 1}
    for s in seeds[:12]:
        for _ in range(25):
            flips = rnd.choice(64, rnd.integers(1, 4), replace=False)
            values.add(int(s) ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "value long")
    for budget in (0, 1, 2):
        links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.near_links(frame, budget).collect()]
        assert all(bin(a ^ b).count("1") <= 2 * 64 for a, b in links)
        want = brute.components(sorted(values), lambda a, b: bin(a ^ b).count("1") <= budget)
        got = {v: v for v in values}
        for a, b in links * len(values):
            low = min(got[a], got[b])
            if got[a] == got[b] == low:
                continue
            got[a] = got[b] = low
        stable = {v: got[v] for v in values}
        assert len(set(map(str, stable.values()))) == len(set(want.values()))
        assert all(stable[v] == want[v] for v in values)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r["u"]: r["root"] for r in components.components(frame).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}, 201: 200}
    assert components.components(frame.limit(0)).count() == 0


def test_columns_named_like_internal_ones_change_nothing(spark):
    rows = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 3).alias("v"))
    plain = {(r.key, r.shard, r.slot) for r in sharding.assign_shards(rows, "key", 7).collect()}
    names = ["_cell", "_hash", "_copies", "_first", "_from", "_nth", "_rank", "_begin", "_end", "_slot", "c0", "a.b", "shard", "slot"]
    clashing = rows.toDF("key", "_cell").select("*", *[F.lit(1).alias(n) for n in names[1:]])
    found = sharding.assign_shards(clashing, "key", 7)
    assert found.columns == ["key", *names[:-2], "shard", "slot"]
    assert {(r.key, r.shard, r.slot) for r in found.collect()} == plain


# ------------------------------------------------------------- winnowing, repeats, tokens


def test_spans_and_items_are_real_outputs(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{awkward_dir}/benchmark.parquet"))
    assert {"item_ids", "n_hit"} <= set(found.columns) and found.where("n_items > 0").count() > 3


def test_long_texts_are_read_in_stretches(spark, monkeypatch, awkward_dir):
    monkeypatch.setattr(suffix_dedup, "TEXT_AT_ONCE", 1000)
    import numpy as np

    text = np.frombuffer(brute.table(awkward_dir, "documents")[3]["text"].encode() * 40, np.uint8)[:9000]
    at = np.array([0, len(text)])
    whole = set(zip(*[x.tolist() for x in suffix_dedup.entering(text, at[:-1], at[1:] - 99, at[:-1], at[1:] - 100)[1:]]))
    cut = set()
    for _, position, start, end, bucket, all_bytes, shift in suffix_dedup._suffixes(text, at):
        cut |= set(zip(*(x.tolist() for x in (position + shift, start + shift, end + shift, bucket, all_bytes))))
    assert cut == whole


def test_repeat_spans_are_real_outputs(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    row = suffix_dedup.remove_repeats(docs).where("n_spans > 0").first()
    assert sum(b - a for a, b in row["spans"]) == row["n_removed"]


def test_repeats_of_rows_without_id_and_of_texts_under_one_id(spark):
    """One passage: rows without an id come last, texts under one id in some fixed order, equal rows are one."""
    passage = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    rows = [(5, "a" + passage), (5, "b" + passage), (None, "c" + passage), (9, passage + "d"), (9, passage + "d"), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, base long, ord long")
    found = suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed").collect()
    n = len(passage)
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (0, n), (5, 0), (5, n), (7, 0), (9, n), (9, n)]


def test_word_encoder_agrees_with_the_tokenizer(sf_dir):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    coder = token_files.WordEncoder(path)
    texts = [d["text"] for d in brute.table(sf_dir, "documents") if d["text"]]
    texts += ["a  b", " a", "a ", "a\n\nb", "don't\nwe'll 's", "\n", "x y", "a \nb", "<|endoftext|>", "x\x1cy z", "é́ ñ"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert list(memoryview(ids).cast("H")) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_word_encoder_with_few_words_remembered(sf_dir):
    path = token_files.default_tokenizer()
    texts = [d["text"] for d in brute.table(sf_dir, "documents") if d["text"]]
    few, whole = token_files.WordEncoder(path, cached_words=50), token_files.WordEncoder(path)
    want = whole.encode(texts)
    assert [i for t in texts for i in few.encode([t])] == want
    assert len(few.known) < len(whole.known) / 2


def test_spans_are_extended_once(spark, sf_dir):
    found = decontaminate.op6_decontaminate(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_fit_hands_no_rows_over_from_python(spark, monkeypatch):
    names = ['a "quoted" one', "b\nline", "\u00e9\u4e2d"]
    docs = spark.createDataFrame(
        [(i, f"{'xyz'[i % 3] * 9} {i}", names[i % 3]) for i in range(30)], "doc_id long, text string, lang string"
    )

    def refused(*_):
        raise AssertionError("rows from Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    model = language_id.LanguageModel.fit(docs)
    assert model.statistics.languages == tuple(sorted(names))


def test_files_give_back_all_ids(spark, awkward_dir, monkeypatch):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet").withColumn("part", F.lit("mine"))
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs, path, token_files.default_tokenizer())
    blocks = token_files.read_token_ids(spark, path).orderBy("part", "block").collect()
    ids = [i for b in blocks for i in b["ids"]]
    rows = token_files.read_token_files(spark, path).collect()
    assert len(ids) == sum(r["n_tokens"] for r in rows) and len(rows) == docs.count()
    assert all(ids[r["start"] + r["n_tokens"] - 1] == token_files.END_ID for r in rows)


# ---------------------------------------------------------------------- secret scan


def test_constants_are_followed():
    text = 'seed = "q9Zr7Lm2Xv5Tn8Wk"\nmiddle := seed\nclient_secret_value = middle + "x"\nname = "q1Wr7Lm2Xv5Tn8Wk"\n'
    spans = {(s.kind, text[s.start : s.end]) for s in secret_scan.scan_text(text)}
    assert ("lexed", "q9Zr7Lm2Xv5Tn8Wk") in spans and not any("q1Wr7" in t for _, t in spans)


@pytest.mark.parametrize(
    "text, found",
    [
        ('{"db": {"passphrase": "Tr0ub4dor&3-horse"}}', ["Tr0ub4dor&3-horse"]),
        ("clientCredentials: 'aB3dE5fG7hI9kL1m'", ["aB3dE5fG7hI9kL1m"]),
        ('password_hint = "changeme"', []),
        ('color = "aB3dE5fG7hI9kL1m"', []),
        ('if (authorization == "aB3dE5fG7hI9kL1m")', []),
        ('pwd => "${ENV_PASSWORD}"', []),
    ],
)
def test_names_score_literals(text, found):
    assert [text[s.start : s.end] for s in secret_scan.scan_text(text) if s.kind == "lexed"] == found


def test_base_spans_are_found_around_literals():
    import random

    draw = random.Random(3)
    for _ in range(300):
        spans = [secret_scan.Span("hex", a, a + draw.randint(0, 9)) for a in (draw.randint(0, 30) for _ in range(draw.randint(0, 6)))]
        covered = secret_scan.covered_by(spans)
        for start in range(32):
            for end in range(start, 42):
                assert covered(start, end) == any(s.start <= start and end <= s.end for s in spans)


def test_many_assignments_take_time_in_proportion():
    import time

    line = "service_password = 'aB3dE5fG7hI9kL{}'\nsession_credential = 'Zr7Lm2Xv5Tn8Wk{}'\n"
    text = "".join(line.format(i, i) for i in range(60_000))
    start = time.perf_counter()
    spans = secret_scan.scan_text(text)
    assert len(text) > 5_000_000 and time.perf_counter() - start < 30
    kinds = Counter(s.kind for s in spans)
    assert kinds["assign"] == 60_000 and kinds["lexed"] == 60_000


def test_a_call_is_no_literal():
    assert lexed('pwd = os.getenv("X")') == [] and lexed("credentials = decodeAll9Zr7Lm2(x)") == []
    assert lexed("pwd = aB3dE5fG7hI9kL1m") == ["aB3dE5fG7hI9kL1m"]


def lexed(text: str) -> list[str]:
    return [text[s.start : s.end] for s in secret_scan.scan_text(text) if s.kind == "lexed"]


def test_no_literal_of_a_name_is_too_many():
    pieces = [f"q{i:03}Zr" for i in range(100)]
    assert lexed("credentials = " + " + ".join(f"'{p}'" for p in pieces)) == pieces
    assert lexed("".join(f"credentials = credentials + '{p}'\n" for p in pieces)) == pieces
    assert lexed("\n".join(f"v = v + '{p}'" for p in pieces) + "\ncredentials = v") == pieces


def test_names_are_read_as_far_as_they_go():
    long = ".".join(["part"] * 40)
    assert lexed(f"password.{long} = 'aB3dE5fG7hI9kL1m'") == ["aB3dE5fG7hI9kL1m"]
    assert lexed(f"{long}.x = 'aB3dE5fG7hI9kL1m'\npwd = {long}.x") == ["aB3dE5fG7hI9kL1m"]
    assert lexed(f"'password.{long}'{' ' * 100}: 'aB3dE5fG7hI9kL1m'") == ["aB3dE5fG7hI9kL1m"]
    assert lexed(f"color.{'x' * 75}pwd = 'aB3dE5fG7hI9kL1m'") == []


@pytest.mark.parametrize(
    "text",
    [
        'pwd: str = "{}"', 'const authToken: string = "{}"', 'let credential: &str = "{}"', "pwd: Optional[str] = '{}'",
        "pwd: str | None = '{}'", 'pwd += "{}"', 'pwd = ["{}"]', 'pwd = """{}"""', "pwd = '''{}'''", "<pwd>{}</pwd>",
        '<pwd kind="x">{}</pwd>', 'pwd = os.getenv("X", "{}")', "pwd = f(\n  'x',\n  '{}',\n)", "pwd = f(other, '{}')",
        "pwd = getenv('APP_SECRET_NAME9_OF_IT', '{}')", "a = ['{}']\npwd = a",
    ],
)
def test_literals_behind_types_and_in_calls(text):
    assert lexed(text.format("aB3dE5fG7hI9kL1m")) == ["aB3dE5fG7hI9kL1m"]


def test_what_is_no_literal_of_a_sensitive_name():
    for text in ("color: str = '{}'", "<p>{}</p>", "<pwd>{}</token>", "note: the value of x = '{}'", "f(pwd, '{}')"):
        assert lexed(text.format("aB3dE5fG7hI9kL1m")) == [], text
    assert lexed("part = 'aB3dE5fG'\npart += '7hI9kL1m'\npwd = part") == ["aB3dE5fG", "7hI9kL1m"]


def test_names_hold_what_copied_lists_hold():
    """Random assignments against lists copied in full and names found in the whole text before."""
    rnd = random.Random(4)
    before = re.compile(r"""(?:^|[^A-Za-z0-9_.$-])\[?(["']?)([A-Za-z_$][A-Za-z0-9_.$-]*)\1\]?[ \t]*\Z""")

    def want(text: str) -> set[tuple[int, int]]:
        values, scores = {}, {}
        found = [(before.search(text[: op.start()]), op) for op in secret_scan.OPERATOR.finditer(text)]
        named = secret_scan.assignments(text)
        assert [n for n, _ in named] == [m[2] for m, op in found if m and secret_scan.TERM.match(text, op.end())]
        for name, terms in named:
            literals = []
            for kind, value, start, end in terms:
                if kind == "bare" and value in values and secret_scan.IDENTIFIER.match(value):
                    literals += values[value]
                elif kind == "literal" or len(terms) == 1:
                    literals.append((value, start, end))
            values[name] = list(dict.fromkeys(literals))
            score = secret_scan.name_weight(name) * secret_scan.strength("".join(v for v, _, _ in values[name]))
            for _, start, end in values[name]:
                scores[start, end] = max(score, scores.get((start, end), 0.0))
        return {k for k, v in scores.items() if v >= secret_scan.LEAST_SCORE and k[1] > k[0]}

    names = ["a", "b", "c", "secret", "x.token", "'pwd'", '["k"]', "d'", "9e", "f:g"]
    words = ["a", "b", "c", "secret", "x.token", "'<'", "'$'", "'{'", "''", "'hunt'", "'Zr7'", "'x:a'", "'none'", "q9Zr7Lm2Xv", "'é9'"]
    some = 0
    for _ in range(3000):
        lines = [
            f"{rnd.choice(names)} {rnd.choice(['=', ':', ':=', '=>', '==', ':a ='])} "
            + " + ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
            for _ in range(rnd.randint(1, 25))
        ]
        text = rnd.choice(["\n", " ; ", " + "]).join(lines)
        expected = want(text)
        some += len(expected)
        assert {(s.start, s.end) for s in secret_scan.lexed_spans(text, [])} == expected, text
    assert some > 3000
