import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from resolvent.functions import parsing, security, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("given, wanted", [("Solaria × VULGA", "solaria x vulga"), ("  Mar-Alta, (fine) ", "mar-alta fine"), (None, ""), ("Ä1", "1"), ("a b", "a b"), ("", "")])
def test_norm(spark, given, wanted):
    assert one(spark, given, text.norm) == wanted


def test_squeeze_takes_no_break_spaces(spark):
    assert one(spark, " a  \tb ", text.squeeze) == "a b"


def test_strip_trailing_parens(spark):
    body, groups = text.strip_trailing_parens(F.col("x"))
    r = spark.createDataFrame([("Solaria vulga (a) (b c)",), ("plain",)], "x string").select(body.alias("b"), groups.alias("g")).collect()
    assert [(x.b, x.g) for x in r] == [("Solaria vulga", ["b c", "a"]), ("plain", [])]


def test_title_parser_takes_the_last_valid_segment(spark):
    titles = ["[QX] Sunleaf - Solaria vulga", "A - Solaria vulga - B", "Raw Leaf", "Sunleaf - SOLARIA vulga (20% rich)", None]
    r = spark.createDataFrame([(t,) for t in titles], "x string").select(parsing.parse_title("x").alias("t")).collect()
    assert [x.t.latin_key for x in r] == ["Solaria vulga", "Solaria vulga", None, "Solaria vulga", None]
    assert r[0].t.country == "[QX]" and r[0].t.common == "Sunleaf"
    assert r[1].t.flags == ["multi_dash_latin_not_final"]
    assert r[2].t.flags == ["suspicious_latin_rejected", "no_latin"]
    assert r[3].t.flags == ["assay_in_latin"]


@pytest.mark.parametrize("raw, ratio, percent, method", [("4:01", "4:1", None, None), ("10", "10:1", None, None), ("0.95", None, 95.0, None), ("20%", None, 20.0, None), ("2.5 % Gr", None, 2.5, "Gravimetric"), ("Solarin 20% by HPLC", None, 20.0, "HPLC"), ("", None, None, None), (None, None, None, None)])
def test_assay(spark, raw, ratio, percent, method):
    a = one(spark, raw, parsing.parse_assay)
    assert (a.ratio, a.percent, a.method) == (ratio, percent, method)


def test_repair_takes_the_longest_genus(spark):
    names = spark.createDataFrame([("SolariaVulga",), ("Solariavulga",), ("Solarianavulga",), ("Other",), (None,)], "name string")
    genera = spark.createDataFrame([("Solaria",), ("Solariana",), ("Solaria",)], "genus string")
    r = {x.name: (x.repaired, x.repair) for x in parsing.repair_names(names, genera).collect()}
    glued = spark.createDataFrame([("Iovulgaris",), ("Iovulga",), ("Solaria1vulga",)], "name string")
    short = {x.name: x.repaired for x in parsing.repair_names(glued, spark.createDataFrame([("Io",), ("Solaria",)], "genus string")).collect()}
    assert short == {"Iovulgaris": "Io vulgaris", "Iovulga": "Iovulga", "Solaria1vulga": "Solaria1vulga"}
    assert r == {"SolariaVulga": ("Solaria Vulga", "case_boundary_split"), "Solariavulga": ("Solaria vulga", "glued_genus_split"), "Solarianavulga": ("Solariana vulga", "glued_genus_split"), "Other": ("Other", "none"), None: ("", "none")}


def test_first_sentence_and_information(spark):
    assert one(spark, "One. Two.", text.first_sentence) == "One."
    assert one(spark, None, text.first_sentence) == ""
    r = spark.createDataFrame([("Fine grain", "It is fine grain, dry."), ("New fact", "Body"), (None, "Body")], "a string, b string").select(text.adds_information("a", "b").alias("y")).collect()
    assert [x.y for x in r] == [False, True, False]


def test_hmac_of_published_vectors(spark):
    for key, message in ((b"\x0b" * 20, "Hi There"), (b"Jefe", "what do ya want for nothing?"), (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First")):
        assert one(spark, message, lambda c, k=key: security.hmac_sha256(c, k)) == hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def token(spark, **changed):
    values = {"v": 1, "iat": 1000, "exp": 1300} | changed
    lit = lambda k: F.lit(values[k]).cast("int" if k == "v" else "long")
    claims = F.struct(lit("v").alias("v"), F.lit("c").alias("cid"), F.lit("p").alias("product"), F.lit("r").alias("role"), F.lit("MP").alias("sf"), lit("iat").alias("iat"), lit("exp").alias("exp"))
    return spark.range(1).select(security.encode_token(claims, b"k").alias("t")).first()["t"]


def test_tokens_fail_with_the_first_reason(spark):
    t = token(spark)
    cases = [
        (t, 1100, b"k", None), (t, 1300, b"k", None), (t, 1301, b"k", "expired"), (t, 940, b"k", None), (t, 939, b"k", "iat_in_future"), (t, 1100, b"other", "bad_signature"), ("x", 1, b"k", "malformed"), (t + ".z", 1, b"k", "malformed"),
        (None, 1, b"k", "malformed"), (".", 1, b"k", "malformed"), (token(spark, v=2), 1100, b"k", "bad_token_version"), (token(spark, iat=None), 1100, b"k", "malformed"), (token(spark, exp=999), 1100, b"k", "bad_expiry"),
        (token(spark, exp=1000), 1000, b"k", None), (token(spark, exp=1360), 1100, b"k", None), (token(spark, exp=1361), 1100, b"k", "ttl_too_long"), (token(spark, iat=5000, exp=5100), 1100, b"k", "iat_in_future"),
    ]
    got = [one(spark, x, lambda c, n=now, k=key: security.verify_token(c, F.lit(n), k)["reason"]) for x, now, key, _ in cases]
    assert got == [wanted for *_, wanted in cases]


def test_a_payload_that_is_no_object_is_malformed(spark):
    import base64

    made = lambda body: body + "." + base64.urlsafe_b64encode(hmac.new(b"k", body.encode(), hashlib.sha256).digest()).decode().rstrip("=")
    coded = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    check = lambda text: one(spark, made(coded(text)), lambda c: security.verify_token(c, F.lit(1), b"k")["reason"])
    assert [check(x) for x in ("5", "null", "{broken", "[]", "{}")] == ["malformed", "malformed", "malformed", "bad_token_version", "bad_token_version"]


EDGE = "198.51.100.7"


@pytest.mark.parametrize(
    "forwarded, transport, wanted",
    [
        (f"203.0.113.9, {EDGE}", EDGE, "203.0.113.9"), (f"6.6.6.6, 203.0.113.9, {EDGE}", EDGE, "203.0.113.9"), ("203.0.113.9", EDGE, "203.0.113.9"), (f"203.0.113.9:54321, {EDGE}", EDGE, "203.0.113.9"), (f"2001:db8::1, {EDGE}", EDGE, "2001:db8::1"),
        (f"not-an-ip, {EDGE}", EDGE, EDGE), ("1.2.3.4, junk", EDGE, EDGE), ("", EDGE, EDGE), (None, None, "no-ip"), (EDGE, EDGE, EDGE), (" , ,", EDGE, EDGE), ("01.02.03.04", EDGE, EDGE), ("::ffff:1.2.3.4", EDGE, "::ffff:1.2.3.4"), ("[fe80::1%eth0]:443", None, "fe80::1"), ("[::1", None, "no-ip"),
    ],
)
def test_the_caller_cannot_choose_the_address(spark, forwarded, transport, wanted):
    r = spark.createDataFrame([(forwarded, transport)], "f string, t string").select(security.client_ip("f", "t").alias("ip"))
    assert r.first()["ip"] == wanted


def test_requests_fail_with_the_first_reason(spark):
    base = {"keys": ["product", "role", "botanical"], "p": "a", "r": "b", "b": "neem", "s": None, "c": None, "known": True}
    cases = [
        ({}, None), ({"keys": None}, "bad_body"), ({"keys": ["odd"], "p": None}, "unexpected_field"), ({"r": None, "b": " "}, "missing_product_role"), ({"b": "x" * 81, "s": "!"}, "bad_botanical"), ({"b": "x" * 80}, None),
        ({"s": "a b", "c": "QQ"}, "bad_session"), ({"s": "x" * 64}, None), ({"s": "x" * 65}, "bad_session"), ({"c": "Other", "known": None}, "bad_candidate_format"), ({"c": "MP", "known": None}, "unknown_product_role"),
    ]
    rows = [tuple((base | changed).values()) for changed, _ in cases]
    df = spark.createDataFrame(rows, "keys array<string>, p string, r string, b string, s string, c string, known boolean").coalesce(1)
    got = df.select(security.validate_request(F.col("keys"), F.col("p"), F.col("r"), F.col("b"), F.col("s"), F.col("c"), ("MP",), F.col("known")).alias("y")).collect()
    assert [x.y for x in got] == [w for _, w in cases]


@pytest.mark.parametrize("stamp, wanted", [("940", True), ("1060", True), ("1061", False), ("x", False), (None, False)])
def test_fresh(spark, stamp, wanted):
    assert one(spark, stamp, lambda c: security.fresh(c, F.lit(1000))) is wanted


def test_pack_sizes_and_stop_words(spark):
    assert one(spark, "Neem 500gm", text.title_candidates) == ["Neem"]
    assert one(spark, "Fresh Organic neem", lambda c: text.ngram_candidates(c, text.BOTANICAL)) == ["Fresh Organic neem", "Fresh Organic", "Fresh"]
    assert one(spark, "azadirachta INDICA powder", lambda c: text.ngram_candidates(c, text.BOTANICAL))[0] == "azadirachta INDICA powder"
    assert one(spark, "azadirachta indica oil", lambda c: text.ngram_candidates(c, text.BOTANICAL))[0] == "Azadirachta indica"
    assert one(spark, "Rosa × alba f. nova cv", text.slug) == "rosa-x-alba-nova"


@pytest.mark.parametrize("given, wanted", [("1.2.3.4", True), ("256.1.1.1", False), ("::1", True), ("1:2:3:4:5:6:7:8", True), ("1::2::3", False), ("x", False), (None, False), ("01.2.3.4", False), ("::ffff:1.2.3.4", True), ("::ffff:1.2.3.256", False), ("::", True), (":::", False), ("1:2:3:4:5:6:7", False), ("1:2:3:4:5:6:1.2.3.4", True), ("1::2:3:4:5:6:7:8", False)])
def test_addresses(spark, given, wanted):
    assert one(spark, given, security.is_ip) is wanted


def test_unknown_format_is_no_verdict(spark):
    from resolvent.operators.decide import assess_candidate

    r = spark.createDataFrame([("MP", None, None), ("MP", "odd text", None), ("SE", "ok", "n")], "c string, t string, n string").select(assess_candidate(F.col("c"), F.col("t"), F.col("n")).alias("a")).collect()
    assert [(x.a.severity, x.a.status) for x in r] == [("neutral", "not_evaluated"), ("avoid", "unsuitable"), ("neutral", "review")]


def test_names_with_hybrid_signs_and_markers(spark):
    names = ["Mentha × piperita", "Salvia cv. Alba", "Rosa canina forma alba", "Rosa", "Rosa ×alba var. nova"]
    got = spark.createDataFrame([(x,) for x in names], "n string").select("n", text.name_parts("n").alias("p")).collect()
    assert {r.n: tuple(r.p) for r in got} == {
        "Mentha × piperita": ("Mentha", "piperita", None, "species"), "Salvia cv. Alba": ("Salvia", "Alba", None, "species"), "Rosa canina forma alba": ("Rosa", "canina", "alba", "infraspecific"),
        "Rosa": ("Rosa", None, None, "genus"), "Rosa ×alba var. nova": ("Rosa", "alba", "nova", "infraspecific"),
    }


def test_odd_spaces_and_late_hyphens_are_seen(spark):
    names = ["a b", "a\u00a0b", "a\u2007b", "a\u2009b", "a\u202fb", "\ufeffa", "Aster novi-belgii", "Aster novus var. alba-rosea", "Aster-x novus", "Aster - b"]
    got = spark.createDataFrame([(x,) for x in names], "n string").select("n", security.name_features("n").alias("f")).collect()
    assert [r.n for r in got if r.f.nbsp] == names[1:6] and [r.n for r in got if r.f.hyphen_epithet] == names[6:8]
