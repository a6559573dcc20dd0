import base64
import collections
import functools
import math
import random
import re

import brute
import pytest

from tessella.llm import op2_urls, op3_rules, op5_resampling, op7_bpe, op8_secrets, queries, texts


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.oracle_sql()[name])


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


# --- url filters ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [op2_urls.MAX_BITS, 200])
def test_cascade_is_exact(spark, monkeypatch, most):
    """Listed domains and single urls among many keys; with few bits, in many parts and several passes."""
    monkeypatch.setattr(op2_urls, "PASS", 3)
    urls = [(i, f"https://h{i}.D{i % 500}.net/x{i % 7}?q={i}") for i in range(3000)] + [(None, None), (1, "no scheme"), (2, "HTTP://A.B.Org:80/es/?q#f"), (2, "://")]
    pages = spark.createDataFrame([(i, u, "k", True, "h") for i, u in urls], "page_id long, url string, key string, listed boolean, host string")
    listed = {f"d{i}.net" for i in range(0, 500, 25)} | {"h5.d5.net", "h17.d17.net/x3", "h17.d17.net/x4"} | {f"h{i}.d{i % 500}.net/x{i % 7}" for i in range(0, 3000, 9)}
    got = op2_urls.url_verdicts(pages, spark.createDataFrame([(k,) for k in listed], "key string"), max_bits=most).collect()
    assert len(got) == len(urls)
    for r in got:
        parts = r["host"].split(".")
        assert r["listed"] == (any(".".join(parts[i:]) in listed for i in range(len(parts))) or r["host"] + r["path"] in listed)
    assert {(r["host"], r["path"], r["verdict"]) for r in got if not r["host"].startswith("h")} == {("", "", "allow"), ("a.b.org:80", "/es/", "allow")}


def test_levels_alternate(spark):
    """Over the pages of the largest given table the cascade has several levels, and stays near what was planned."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    universe = op2_urls.key_universe(pages, op2_urls.listed_keys(pages))
    (made,) = op2_urls.cascades(universe)
    n, others = (universe.filter(x).count() for x in ("listed", "NOT listed"))
    assert len(made.levels) >= 3 and n > 50 and others > 2000
    assert sum(level.bits for level in made.levels) <= 2 * op2_urls.planned_bits(n, others)


def test_rules_of_urls(spark):
    want = {"http://x.example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/12": ("example.org/en/1", "block"), "http://badexample.org/es/": ("org/", "allow"), "http://a.com/de/": ("com/de/", "block"), "http://com/fr/x": ("com/fr/", "allow"), "http://a.com/FR/": (None, "allow"), "http://spam-farm.example.net/": (None, "block")}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = op2_urls.url_verdicts(pages, op2_urls.bad_hosts(spark))
    assert [(r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == list(want.values())
    empty = op2_urls.url_verdicts(pages.limit(0), spark.createDataFrame([], "key string"))
    assert empty.collect() == []
    assert not any(r["listed"] for r in op2_urls.url_verdicts(pages, spark.createDataFrame([], "key string")).collect())


def test_urls_of_bad_families(spark, sf_dir):
    """Every family in pages is listed, by domain or url by url, and nothing else."""
    got = op2_urls.op2_url_cascade(spark, sf_dir).collect()
    bad = re.compile(r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$")
    assert [r["listed"] for r in got] == [bool(bad.search(r["host"])) for r in got] and sum(r["listed"] for r in got) == 3
    assert all(r["verdict"] == "block" for r in got if r["listed"] and r["rule"] is None)


# --- quality rules ----------------------------------------------------------------------------------------------------------


def counts(text):
    text = text or ""
    words, lines = brute.WORD.findall(text), [x for x in text.split("\n") if brute.WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("place", [op3_rules.PLACE, 7])
def test_counts(spark, table, docs, odd, monkeypatch, place):
    """With few places every text takes the way of full hashes."""
    monkeypatch.setattr(op3_rules, "PLACE", place)
    rows = [*docs[:60], *odd, (950, "a b c a b c x"), (951, "a a a a"), (952, "l\nl\n\n \nl")]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in op3_rules.metrics(table(rows)).collect()}
    assert got == {d: counts(t) for d, t in rows}


def test_rules_table(spark, table):
    rules = (op3_rules.Rule("few", "n_words", None, 3), op3_rules.Rule("plain", "n_symbols / n_words", None, 0.5))
    got = {r["doc_id"]: (r["ok_few"], r["ok_plain"], r["passed"]) for r in op3_rules.quality_rules(table([(1, "a b"), (2, "a b c d"), (3, "### x"), (4, None)]), rules).collect()}
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (True, False, False), 4: (True, True, True)}
    assert op3_rules.quality_rules(table([])).collect() == []


# --- importance resampling --------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = op5_resampling.resample(docs, labels.filter("doc_id % 5 <> 0")).join(labels.filter("doc_id % 5 = 0"), "doc_id")
    kept = {r["quality"]: r["k"] for r in got.selectExpr("quality", "double(kept) k").groupBy("quality").avg("k").toDF("quality", "k").collect()}
    assert kept[1] >= 0.99 and kept[0] <= 0.1


def test_draw(spark, table, odd):
    r = random.Random(2)
    good = [(i, " ".join(r.choice(["sea", "tide", "moon", "wave", "wind"]) for _ in range(400))) for i in range(80)]
    junk = [(i, " ".join(r.choice(["sea***", "$$$", "|", "tide%%%"]) for _ in range(400))) for i in range(100, 150)]
    odd = odd[:5]  # one of the others would be most of so small a corpus
    df = table([*good, *junk, *odd, (None, good[0][1])])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(0, 0, 0), (1, 1, 1), (None, 1, 0), (100, 0, None)], "doc_id long, quality int, toxic int")
    scored = op5_resampling.resample(df, labels).collect()
    assert len(scored) == 80 + 50 + len(odd) + 1 and sorted(x["rank"] for x in scored) == list(range(len(scored)))
    kept = {x["doc_id"] for x in scored if x["kept"]}
    assert kept >= set(range(80)) and not kept & set(range(100, 150)) and not kept & {900, 901, 902}
    assert sorted((x["doc_id"] or -1) for x in op5_resampling.drawn(df, labels).collect()) == sorted((x or -1) for x in kept)
    top = op5_resampling.resample(df, labels, k=7).collect()
    assert sum(x["kept"] for x in top) == 7 and sorted(x["rank"] for x in top if x["kept"]) == list(range(7))
    assert op5_resampling.resample(table([]), labels).collect() == [] and op5_resampling.drawn(table([]), labels).collect() == []
    nothing = op5_resampling.resample(df, labels.limit(0)).collect()
    assert all(x["kept"] == (x["n_grams"] > 0) for x in nothing)


def plain_draw(rows, labels, k=None):
    """id -> (n-grams, log weight, kept) of rows (id, text) with distinct ids, in plain whole numbers and floats."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    @functools.cache
    def token(raw):
        state = mix(len(raw) * texts._BASE & top)
        if len(raw) > texts.LONG:
            return texts.digest(raw) & top
        for i in range(0, len(raw), 8):
            state = mix((state ^ int.from_bytes(raw[i : i + 8], "little")) * texts._INVERSE & top)
        return state

    def buckets(text):
        found = [token(m) for m in re.findall(rb"[!-/:-@\[-`{-~]+|[^\x20\x09-\x0D!-/:-@\[-`{-~]+", (text or "").encode())]
        pairs = [mix((a * 0x9E3779B97F4A7C15 + b) & top) for a, b in zip(found, found[1:], strict=False)]
        return [h % op5_resampling.BUCKETS for h in found + pairs]

    grams = {d: buckets(t) for d, t in rows}
    good = {d for d, q, t in labels if q == 1 and not t} - {d for d, q, t in labels if q != 1 or t}
    raw, aim = collections.Counter(), collections.Counter()
    for d, found in grams.items():
        raw.update(found)
        if d in good:
            aim.update(found)
    every, n, most = range(op5_resampling.BUCKETS), raw.total(), aim.total()
    base = [(raw[i] + 1) / (n + len(every)) for i in every]
    ratio = [(aim[i] + op5_resampling.SHRINK) / (most * base[i] + op5_resampling.SHRINK) for i in every]
    whole = sum(p * r for p, r in zip(base, ratio, strict=True))
    weight = {d: sum(math.log(ratio[i] / whole) + op5_resampling.LASTING for i in found) for d, found in grams.items()}
    noise = {d: -math.log(-math.log(((mix((d ^ op5_resampling.SEED * 0x9E3779B97F4A7C15) & top) >> 11) + 0.5) / (1 << 53))) for d in grams}
    able = [d for d in grams if grams[d]]
    k = sum(weight[d] >= 0 for d in able) if k is None else k
    kept = set(sorted(able, key=lambda d: (-(weight[d] + noise[d]), d))[:k])
    return {d: (len(grams[d]), weight[d], d in kept) for d in grams}, {d for d in able if weight[d] >= 0}


@pytest.mark.parametrize("k", [None, 60])
def test_draw_is_plain_gumbel_top_k(spark, table, docs, sf_dir, odd, k):
    """Counts, weights and the draw against plain code; the noise decides some of it."""
    short = [(5000 + i, " ".join(t.split()[i % 9 : i % 9 + 4])) for i, (_, t) in enumerate(docs) if len(t.split()) > 12]
    rows, labels = [*docs, *odd, *short], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want, above = plain_draw(rows, labels, k)
    found = op5_resampling.resample(table(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k).collect()
    got = {r["doc_id"]: (r["n_grams"], pytest.approx(r["log_weight"], abs=1e-6), r["kept"]) for r in found}
    assert want == got
    if k is None:
        assert {d for d in want if want[d][2]} != above  # a draw, not a cut


# --- tokens -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op7_bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_as_the_library(library, odd):
    coder = op7_bpe.Coder(op7_bpe.read_vocabulary(op7_bpe.vocabulary_path()))
    r = random.Random(1)
    bits = ["a", "b", " ", "th", "e ", "ing", "\n", "'s", "9", "é", "中", "!", "?? ", "😀", "<|endoftext|>", "՘", "\U000323b0", "\U00010940"]
    texts = [t or "" for _, t in odd] + ["a" * 5000, "<|endoftext|>a<|endoftext|> <|endoftext|", "    x 　y "]
    texts += ["".join(r.choice([*bits, chr(r.randrange(0x300, 0xD7FF)), chr(r.randrange(0x10000, 0x1FFFF))]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == want
        assert coder.round_trip(t) == (len(want), ",".join(map(str, want)), library.decode(want, skip_special_tokens=False))
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_tree_takes_the_leftmost_lowest_pair():
    merges = {(0, 1): (1, 3), (1, 2): (0, 4), (3, 4): (2, 5), (0, 4): (5, 6), (6, 6): (9, 7)}

    def plain(s):
        s = list(s)
        while best := min(((merges[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in merges), default=None):
            s[best[1] : best[1] + 2] = [merges[s[best[1]], s[best[1] + 1]][1]]
        return s

    r = random.Random(0)
    for n in [2, 3, 4, 5, 9, 17, 64, 200]:
        s = [r.randrange(3) for _ in range(n)]
        assert op7_bpe.PairTree(list(s), merges).merge() == plain(s)


def test_the_cache_forgets(library, monkeypatch):
    """With room for few parts results are the same, and what is held stays within the room."""
    monkeypatch.setattr(op7_bpe, "CACHE", 8)
    coder = op7_bpe.Coder(op7_bpe.read_vocabulary(op7_bpe.vocabulary_path()))
    text = " ".join(f"word{i % 23} the {i}" for i in range(200))
    want = library.encode(text, add_special_tokens=False).ids
    assert coder.round_trip(text) == (len(want), ",".join(map(str, want)), text)
    assert len(coder.written) <= 4 and len(coder.older) <= 4


def test_tokens_with_other_rules_are_refused(tmp_path):
    import json

    spec = json.loads(open(op7_bpe.vocabulary_path(), encoding="utf-8").read())
    for flag in ("lstrip", "rstrip", "single_word"):
        changed = spec | {"added_tokens": [spec["added_tokens"][0] | {flag: True}]}
        (tmp_path / "v.json").write_text(json.dumps(changed))
        with pytest.raises(ValueError, match=flag):
            op7_bpe.read_vocabulary(str(tmp_path / "v.json"))


def test_round_trips(spark, table, docs, odd, library):
    rows = [*docs[:40], *odd, (None, "x"), (903, "again")]
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op7_bpe.round_trips(table(rows), op7_bpe.vocabulary_path()).collect())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d or -1, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")))
    assert got == sorted(want)
    assert op7_bpe.encode(table([(1, "hi there")]), op7_bpe.vocabulary_path()).first()["ids"] == library.encode("hi there").ids
    assert op7_bpe.round_trips(table([]), op7_bpe.vocabulary_path()).collect() == []


# --- secrets ----------------------------------------------------------------------------------------------------------------


def tlv(tag, value):
    n = len(value)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)) + value


def secret_texts():
    b64 = lambda x: base64.b64encode(x).decode()
    url = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    field = lambda v: len(v).to_bytes(4) + v
    rsa = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, bytes([7] * 60)) for _ in range(8)))
    pkcs8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, b"k" * 32)))
    sec1 = tlv(0x30, tlv(2, b"\1") + tlv(4, b"s" * 32))
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(b"pub") + field(b"priv" * 8)
    token = f"{url(b'{"alg":"HS256"}')}.{url(b'{"sub":1}')}.{url(b'x' * 20)}"
    armour = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(rsa))) + "\n-----END RSA PRIVATE KEY-----"
    yes = {"é " + token: ["jwt"], "k " + b64(rsa): ["der"], b64(pkcs8): ["der"], pkcs8.hex() + " q": ["hex", "der"], sec1.hex().upper(): ["hex", "der"], b64(ssh): ["ssh"], armour: ["pem"], "API_KEY: 'abcdef'": ["assign"], "AKIA" + "Q" * 16: ["access"]}
    locked = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, b"")) + tlv(4, b"e" * 48))
    digest = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")) + tlv(5, b"")) + tlv(4, b"h" * 32))
    block = lambda name, body: f"-----BEGIN {name}-----\n{body}\n-----END {name}-----"
    headed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n"
    yes |= {'{"key": "' + armour.replace("\n", "\\n") + '\\n"}': ["pem"], "y " + b64(locked): ["der"], block("ENCRYPTED PRIVATE KEY", b64(locked)): ["pem", "der"], block("RSA PRIVATE KEY", headed + b64(b"c" * 64)): ["pem"]}
    no = [b64(rsa[:-3]), b64(rsa + b"x"), b64(ssh[:-1]), url(b'{"typ":"JWT"}') + "." + url(b"{}") + ".x", "eyJhbGciOiJIUzI1NiJ9.notjson.x", "password: token: abcdefghi", "paſſword=abcdefgh", "AKIA" + "Q" * 15, armour.replace("M", "N", 1), None, "", "f" * 23]
    no += [b64(digest), block("RSA PRIVATE KEY", headed + b64(b"c" * 65)), block("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\n\n" + b64(b"c" * 64)), "-----BEGIN RSA PRIVATE KEY-----" * 3 + armour[40:]]
    return yes, no


def test_confirmed_secrets(spark, table):
    yes, no = secret_texts()
    rows = list(enumerate([*yes, *no]))
    got = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in op8_secrets.secret_spans(table(rows, 1)).collect()}
    assert [got[i] for i in range(len(yes))] == list(yes.values())
    assert all(got[i] == [] for i in range(len(yes), len(rows)))
    hidden = {r["doc_id"]: r["text"] for r in op8_secrets.redact(table(rows)).collect()}
    assert hidden[0] == "é [SECRET]" and hidden[len(yes)] == no[0] and hidden[len(yes) + no.index(None)] is None
    assert op8_secrets.secret_spans(table([])).collect() == []


def test_base_spans(spark, table, docs, odd):
    r = random.Random(7)
    bits = ["password", "Token", "api_key", "apikey", "=", ": ", "'", '"', "abcdef", "0123456789abcdef", "AKIA", "QWERTY", " ", "secret", "é", "--", "ff" * 12]
    rows = [*docs, *odd, *((3000 + i, "".join(r.choice(bits) for _ in range(r.randint(1, 25)))) for i in range(400))]
    got = {x["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in x["found"] if s["kind"] in op8_secrets.BASE] for x in op8_secrets.secret_spans(table(rows)).collect()}
    assert got == {d: brute.base_spans(t) for d, t in rows}
