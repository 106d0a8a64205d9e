"""Names of organisations and people as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the name rules.
FILLER_WORDS = "THE LA LE LES DU DE DES OF AND ET FOR POUR A AU AUX CANADA INC INCORPORATED LTD LIMITED LIMITEE CORP CORPORATION CO COMPANY FOUNDATION FONDATION SOCIETY SOCIETE ASSOCIATION SOCIETYOF CENTRE CENTER CHURCH EGLISE MINISTRY MINISTERE".split()
STOP_TOKENS = "THE A AN OF AND FOR IN TO BY LTD LIMITED INC INCORPORATED CORP CORPORATION CO COMPANY LP LLP GP ULC ALBERTA CANADA CANADIAN".split()
LEGAL_SUFFIXES = ["LTD", "LIMITED", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LP", "LLP", "GP", "ULC", "SOCIETY", "ASSOCIATION", "ASSN", "FOUNDATION", "FUND", "OF ALBERTA", "OF CANADA", "THE"]
ABBREVIATIONS = {
    "UNIV": "UNIVERSITY", "U OF": "UNIVERSITY OF", "DEPT": "DEPARTMENT", "GOVT": "GOVERNMENT", "GOV": "GOVERNMENT", "ASSN": "ASSOCIATION", "ASSOC": "ASSOCIATION", "INTL": "INTERNATIONAL", "INT": "INTERNATIONAL", "NATL": "NATIONAL", "NAT": "NATIONAL",
    "CTR": "CENTRE", "CNTR": "CENTRE", "CENTER": "CENTRE", "HOSP": "HOSPITAL", "SVS": "SERVICES", "SVCS": "SERVICES", "SVC": "SERVICE", "SERV": "SERVICE", "MGMT": "MANAGEMENT", "MUN": "MUNICIPAL", "MUNICIP": "MUNICIPAL", "PROV": "PROVINCIAL",
    "FDN": "FOUNDATION", "FNDN": "FOUNDATION", "SOC": "SOCIETY", "INST": "INSTITUTE", "TECH": "TECHNOLOGY", "DEV": "DEVELOPMENT", "COMM": "COMMUNITY", "ENVIRO": "ENVIRONMENT", "ENVIRON": "ENVIRONMENT", "EDUC": "EDUCATION", "EDU": "EDUCATION",
    "AGRIC": "AGRICULTURE", "AG": "AGRICULTURE", "ST": "SAINT", "MT": "MOUNT", "FT": "FORT",
}
CATEGORY_STOPWORDS = "the of and for in to a an on at by or with as from into is are be this that these those service services program programs project projects support supports grant grants contribution contributions fund funding initiative initiatives".split()
# The patterns that normalisation removes, in order. Each reaches to the end of the name, to its start, or is
# removed wherever it stands.
TRANSLATION_TAILS = (r"\s+[│|]\s+.*$", r"\s+/\s+.*$", r"\s*[│|].*$")
TRADE_NAME_TAIL = r"\s+(TRADE\s+NAME\s+OF|O\s*/\s*A|D\s*/\s*B\s*/\s*A|DBA|DOING\s+BUSINESS\s+AS|OPERATING\s+AS|TRADING\s+AS|T\s*/\s*A|ASSUMED\s+NAME|AKA|A\.K\.A\.|FORMERLY|F\s*/\s*K\s*/\s*A)\b.*$"
THE_LAST, THE_FIRST, STRAY_POINT = r"\(THE\)\s*$", r"^THE\s+", r"[,\s]+\.\s*$"
PUNCTUATION = r"""[.,;:'"()\-/\\#&!@`]+"""
SPACES = r"\s{2,}"
_PUNCTUATION = r"""[.,;:'"()\-/\\#&!@]+"""


def _sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def norm_name(name: Column) -> Column:
    """Canonical organisation name: bilingual and trade-name tails, THE, punctuation and spacing removed, upper case."""
    n = F.coalesce(name, F.lit(""))
    for pattern in TRANSLATION_TAILS:
        n = _sub(n, pattern)
    n = F.upper(F.trim(n))
    for pattern in (TRADE_NAME_TAIL, THE_LAST, THE_FIRST, STRAY_POINT):
        n = _sub(n, pattern)
    return F.trim(_sub(_sub(n, PUNCTUATION, " "), SPACES, " "))


def strict_name(name: Column) -> Column:
    """Name without filler words: & reads AND, only A-Z, 0-9 count. Filler is dropped wherever it stands, neighbours included."""
    words = F.split(F.trim(_sub(_sub(F.upper(F.coalesce(name, F.lit(""))), "&", " AND "), "[^A-Z0-9 ]", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(FILLER_WORDS)), " ")


def plain_name(name: Column) -> Column:
    """Upper case with punctuation as spaces."""
    return F.trim(_sub(_sub(F.upper(F.trim(F.coalesce(name, F.lit("")))), _PUNCTUATION, " "), r"\s+", " "))


def deep_name(name: Column) -> Column:
    """Order-free name: abbreviations written out one after the other, legal suffixes dropped, words sorted."""
    n = plain_name(name)
    for short, full in ABBREVIATIONS.items():
        n = _sub(n, rf"\b{short}\b", full)
    for suffix in LEGAL_SUFFIXES:
        n = F.trim(_sub(n, rf"\b{suffix}\b"))
    return F.array_join(F.array_sort(F.filter(F.split(n, r"\s+"), lambda w: w != "")), " ")


def person_name(first: Column, last: Column) -> Column:
    whole = F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
    return F.trim(_sub(_sub(F.upper(whole), "[^A-Z0-9 ]", ""), r"\s+", " "))


def person_display(first: Column, last: Column) -> Column:
    whole = F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
    return F.upper(_sub(whole, r"\s+", " "))


def vendor_key(name: Column) -> Column:
    return F.trim(_sub(F.upper(F.trim(name)), "[^A-Z0-9]+", " "))


def bn_root(raw: Column) -> Column:
    """First nine digits of a business number; null if there are fewer or they are a sentinel."""
    digits = _sub(raw, "[^0-9]", "")
    root = F.left(digits, F.lit(9))
    return F.when((F.length(digits) >= 9) & ~root.rlike("^[0-9]0{8}$") & ~root.rlike("^0{3}"), root)


# Defect patterns of business numbers, the first that matches counts.
BN_DEFECTS = [
    ("01_embedded_space", " "), ("02_RC_payroll_program", "^[0-9]{9}RC[0-9]"), ("03_RT_gst_hst_program", "^[0-9]{9}RT[0-9]"), ("04_RP_payroll_program", "^[0-9]{9}RP[0-9]"), ("05_EE_invalid_program", "^[0-9]{9}EE[0-9]"),
    ("06_single_R_missing_one", "^[0-9]{9}R[0-9]+$"), ("07_RR_suffix_short", "^[0-9]{9}RR[0-9]{1,3}$"), ("08_RR_suffix_long", "^[0-9]{9}RR[0-9]{5,}$"), ("09_nine_digits_no_suffix", "^[0-9]{9}$"), ("10_root_eight_digits", "^[0-9]{8}RR[0-9]{4}$"),
    ("11_root_too_long", "^[0-9]{10,}RR"), ("12_fewer_than_nine_digits", "^[0-9]{1,8}$"), ("13_non_numeric", "^[^0-9]|^$"),
]


def bn_defect(bn: Column) -> Column:
    """What is wrong with a charity number; null for valid and placeholder numbers."""
    found = F.when(bn.isNull() | bn.rlike("^0{9}") | bn.rlike("^[0-9]{9}RR[0-9]{4}$"), F.lit(None).cast("string"))
    for name, pattern in BN_DEFECTS:
        found = found.when(bn.rlike(pattern), name)
    return found.otherwise("14_other")


def alternate_names(name: Column) -> Column:
    """Names on both sides of the first separator that applies: trade name, O/A, DBA, bar, trailing comma and full stop."""
    parts = lambda pattern: F.filter(F.transform(F.split(name, pattern), lambda x: F.trim(x)), lambda p: F.length(p) > 2)
    got = (
        F.when(name.rlike(r"(?i)trade\s+name\s+of"), parts(r"(?i)\s+trade\s+name\s+of\s+"))
        .when(name.rlike(r"(?i)\s+O/A\s+"), parts(r"(?i)\s+O/A\s+"))
        .when(name.rlike(r"(?i)\s+DBA\s+"), parts(r"(?i)\s+DBA\s+"))
        .when(name.contains("|"), parts(r"\|"))
        .when(name.rlike(r",\s*\.\s*$"), F.array(F.trim(_sub(name, r",\s*\.\s*$"))))
    )
    return F.when(F.size(got) > 0, got).otherwise(F.array(name))


def core_tokens(name: Column) -> Column:
    """Distinct words longer than one letter that tell organisations apart."""
    clean = _sub(_sub(plain_name(name), r"\bTRADE\s+NAME\s+OF\b.*$"), r"\|.*$")
    return F.array_distinct(F.filter(F.split(F.trim(clean), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_TOKENS)))


def token_overlap(query: Column, candidate: Column) -> Column:
    """Share of query tokens met in the candidate: equal, plural, or one the start of the other from five letters on."""

    def meets(q: Column) -> Column:
        return F.exists(candidate, lambda c: (c == q) | (c == F.concat(q, F.lit("S"))) | (q == F.concat(c, F.lit("S"))) | (F.startswith(c, q) & (F.length(q) >= 5)) | (F.startswith(q, c) & (F.length(c) >= 5)))

    return F.when((F.size(query) == 0) | (F.size(candidate) == 0), 0.0).otherwise(F.size(F.filter(query, meets)) / F.size(query))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def set_similarity(x: Column, y: Column) -> Column:
    """Shared share of two arrays without repeats."""
    both = F.size(F.array_intersect(x, y))
    return F.try_divide(both.cast("double"), F.size(x) + F.size(y) - both)


def category_key(text: Column) -> Column:
    """Sorted distinct words of three letters and more without stop-words; the cleaned text if none is left."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)), lambda w: (F.length(w) >= 3) & ~w.isin(CATEGORY_STOPWORDS))
    key = F.array_join(F.array_sort(words), " ")
    return F.when(key != "", key).otherwise(F.lower(F.trim(_sub(text, "[^A-Za-z0-9]+", " "))))


def printable(text: Column) -> Column:
    return _sub(text, "[^ -~]", "")


def recipient_key(bn: Column, name: Column, *place: Column) -> Column:
    """BN: and nine digits where the number has them, else name and place."""
    digits = F.left(_sub(F.coalesce(bn, F.lit("")), "[^0-9]", ""), F.lit(9))
    parts = [F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (name, *place)]
    return F.when(F.length(digits) > 0, F.concat(F.lit("BN:"), digits)).otherwise(F.concat_ws("|", *parts))


# Words that tell usual networks and public bodies by name.
DENOMINATIONS = "(ROMAN CATHOLIC|SEVENTH-DAY ADVENTIST|ANGLICAN|DIOCESE|PARISH|BAPTIST|PRESBYTERIAN)"
FEDERATIONS = "(UNITED WAY|YMCA|YWCA|FEDERATION|FEDERATED|COMMUNITY FOUNDATION)"
CARE = "(HOSPITAL|HEALTH)"
GOVERNMENT = ["government", "gouvernement", "province of", "province de", "ministry", "ministère", "ministre", "batch report", "rapport en lots"]


def loop_label(names: Column) -> Column:
    """What the joined names of a loop's members suggest: a usual network, or something to review."""
    n = F.upper(F.coalesce(names, F.lit("")))
    return (
        F.when(n.rlike(DENOMINATIONS), "likely_normal_denominational_network").when(n.contains("FOUNDATION") & n.rlike(CARE), "likely_normal_foundation_operator")
        .when(n.rlike(FEDERATIONS), "likely_normal_federated_network").otherwise("review"))


def pair_label(a: Column, b: Column) -> Column:
    """The same for two organisations, whichever comes first."""
    x, y = F.upper(a), F.upper(b)
    either = lambda test, other: (test(x) & other(y)) | (test(y) & other(x))
    both = lambda word: x.contains(word) & y.contains(word)
    trust = either(lambda n: n.contains("UNIVERSITY"), lambda n: n.like("%EMPLOYEES%CHARITY%TRUST%"))
    operator = either(lambda n: n.contains("FOUNDATION"), lambda n: n.rlike(CARE))
    return (
        F.when(trust, "likely_normal_university_affiliate").when(operator, "likely_normal_foundation_operator")
        .when(both("SEVENTH-DAY ADVENTIST") | both("ROMAN CATHOLIC"), "likely_normal_denominational_network").otherwise("review"))


def is_government(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    found = F.lit(False)
    for word in GOVERNMENT:
        found = found | n.contains(word)
    return found


def _words(listed) -> Column:
    return F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")


def text_match(words: Column, all_of, any_of=(), none_of=()) -> Column:
    """Whether a text, as its list of words, holds all words of the first list, one of the second if there is any, none of the third."""
    found = F.size(F.array_except(_words(all_of), words)) == 0
    if any_of:
        found = found & F.arrays_overlap(words, _words(any_of))
    return found & ~F.coalesce(F.arrays_overlap(words, _words(none_of)), F.lit(False))


def text_rank(words: Column, wanted) -> Column:
    """Share of a text's words that are wanted ones."""
    return F.try_divide(F.size(F.filter(words, lambda w: w.isin(list(wanted)))).cast("double"), F.size(words))
