"""Scalar Column expressions (H1-H9, H12-H17). All JVM-side, no Python UDFs.

Regexes use the subset shared by Java and RE2 (no look-around), so the same
pattern text serves the Spark plan and the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference) --------------------------------
# H2: ordered type -> keyword rules; the name is lower-cased and padded with one
# space on each side, the first type with any keyword contained in it wins.
TYPE_KEYWORDS = [
    ("perfume", ["perfume", "eau de parfum", "eau de toilette", "fragrance", "deo", "deodorant", "body mist"]),
    ("earring", ["earring", "earrings", "hoop", "stud"]),
    ("bracelet", ["bracelet", "bangle", "cuff"]),
    ("ring", [" ring", "rings"]),
    ("necklace", ["necklace", "chain", "pendant"]),
    ("watch", ["watch", "smartwatch"]),
    ("shoe", ["shoe", "sneaker", "loafer", "boot", "sandals", "sandal", "heels", "flats"]),
    ("shirt", ["shirt", "t-shirt", "tee"]),
    ("trouser", ["trouser", "pant", "pants", "jeans", "chino", "jogger"]),
    ("dress", ["dress", "gown"]),
]
# H2, second rule set (app): the lower-cased name as it is, first hit wins
APP_TYPE_KEYWORDS = [
    ("sweatshirt", ["sweatshirt", "hoodie"]),
    ("bra", [" bra", "bras", "bralette", "lingerie", "sports bra", "underwear"]),
    ("tshirt", ["t-shirt", "tshirts", "tshirt", "tee shirt", " t shirt"]),
    ("shirt", ["casual shirt", "formal shirt", "printed shirt", "striped shirt", "check shirt", "slim shirt",
               "regular shirt", "solid shirt"]),
    ("trouser", ["trouser", "track pant", "jogger", "chino", " pant ", "palazzo"]),
    ("jean", ["jeans", " jean "]),
    ("short", ["shorts", " short "]),
    ("skirt", ["skirt"]),
    ("dress", ["dress", "gown", "maxi"]),
    ("legging", ["legging", "tights"]),
    ("kurti", ["kurti", "kurtis"]),
    ("kurta", ["kurta set", " kurta"]),
    ("saree", ["saree", " sari"]),
    ("suit", ["bandhgala suit", "blazer suit", " suit"]),
    ("jacket", ["jacket", "blazer", "coat "]),
    ("top", [" top ", "crop top", "tank top", "camisole"]),
    ("shoe", ["sneaker", "loafer", "boot ", "oxford", "moccasin", "casual shoes", "sports shoes", "running shoes",
              "walking shoes"]),
    ("sandal", ["sandal", "slipper", "flip flop", "chappal"]),
    ("heel", ["heels", "stiletto", "wedge", "platform heel"]),
    ("flat", ["ballet flat", "flats"]),
    ("backpack", ["backpack", "rucksack"]),
    ("handbag", ["handbag", "tote bag", "clutch", "satchel", "shoulder bag"]),
    ("bag", ["trolley bag", "duffel", "gym bag", "travel bag", " bag"]),
    ("wallet", ["wallet", "card holder", "card case"]),
    ("watch", ["watch", "smartwatch"]),
    ("ring", [" ring", "finger ring"]),
    ("earring", ["earring", " earrings", " studs", " hoops", "ear ring"]),
    ("necklace", ["necklace", "chain "]),
    ("bracelet", ["bracelet", " bangle"]),
    ("bangle", ["bangle"]),
    ("pendant", ["pendant"]),
    ("perfume", ["perfume", "deodorant", "body mist", "fragrance", "deo "]),
    ("sunglasses", ["sunglass", "sunglasses", "eyewear"]),
    ("cap", [" cap", " hat ", "beanie"]),
    ("belt", [" belt"]),
    ("sock", [" sock", " socks"]),
]
# H3 (app): canonical type -> the texts that mean it; any other text is shown in title case
APP_TYPE_LABELS = [
    ("Tshirt", ["tshirt", "tshirts", "t-shirt", "t-shirts", "tee", "tees"]),
    ("Shirt", ["shirt", "shirts"]),
    ("Top", ["top", "tops"]),
    ("Trouser", ["trouser", "trousers", "track pant", "track pants", "pants"]),
    ("Jeans", ["jeans"]),
    ("Short", ["short", "shorts"]),
    ("Skirt", ["skirt", "skirts"]),
    ("Jacket", ["jacket", "jackets"]),
    ("Sweatshirt", ["sweatshirt", "sweatshirts"]),
    ("Shoe", ["shoe", "shoes", "sports shoes", "casual shoes"]),
    ("Sandal", ["sandal", "sandals", "sports sandals"]),
    ("Flat", ["flat", "flats"]),
    ("Heel", ["heel", "heels"]),
    ("Backpack", ["backpack", "backpacks"]),
    ("Handbag", ["handbag", "handbags"]),
    ("Ring", ["ring", "rings"]),
    ("Earring", ["earring", "earrings"]),
    ("Bangle", ["bangle", "bangles"]),
    ("Bracelet", ["bracelet", "bracelets"]),
    ("Bra", ["bra", "bras"]),
    ("Kurta", ["kurta", "kurtas"]),
    ("Kurti", ["kurti", "kurtis"]),
]
# H3 (app): category labels, categories too broad to be a type, and type -> category groups
APP_CATEGORY_MISSING = ["", "unknown", "none", "null", "nan"]
APP_CATEGORY_LABELS = [
    ("Shoes & Footwear", ["shoes", "footwear"]),
    ("Apparel", ["apparel"]),
    ("Accessories", ["accessories"]),
    ("Personal Care", ["personal care"]),
    ("Sporting Goods", ["sporting goods"]),
]
APP_BROAD_CATEGORIES = ["apparel", "accessories", "footwear", "sporting goods", "unknown"]
APP_CATEGORY_GROUPS = [
    ("Shoes & Footwear", ["Shoe", "Sandal", "Flat", "Heel"]),
    ("Accessories", ["Backpack", "Handbag", "Bag", "Wallet", "Ring", "Earring", "Bangle", "Bracelet", "Necklace",
                     "Pendant", "Watch", "Sunglasses", "Cap", "Belt", "Sock"]),
    ("Personal Care", ["Perfume"]),
]
# H3: values treated as missing, and type -> catalog category groups
MISSING_TEXT = ["unknown", "none", "nan", ""]
CATEGORY_GROUPS = [
    ("personal care", ["perfume"]),
    ("accessories", ["earring", "bracelet", "ring", "necklace", "watch", "wallet", "bag"]),
    ("shoes & footwear", ["shoe", "sandal", "heel", "flat"]),
]
# H5: budget phrase
BUDGET_PATTERN = r"(?:under|below|less than|upto|up to)\s*(?:inr|rs\.?|₹)?\s*(\d{2,7})"
# H4: filler words removed from search text
QUERY_STOPWORDS_PATTERN = (
    r"\b(show me|show|find|search|search for|get|give me|best|please|for me|good|great|nice|some|"
    r"recommend|recommended|affordable|cheap|stylish|cool|top|new|latest|what|which|who|can|could|"
    r"would|should|do|does|have|has|had|i|me|my|we|us|you|your|want|need|like|choose|from|with|"
    r"within|there|any|options|option|looking|look|browse|available|help)\b")
# H4: canonical term replacements, applied in this order
CANONICAL_TERMS = [
    (r"\bt[\s\-]?shirts?\b", "tshirt"),
    (r"\btees?\b", "tshirt"),
    (r"\btrousers?\b", "trouser"),
    (r"\bpants?\b", "trouser"),
    (r"\bjeans?\b", "jean"),
    (r"\bshorts?\b", "short"),
    (r"\bskirts?\b", "skirt"),
    (r"\btops?\b", "top"),
    (r"\bshirts?\b", "shirt"),
    (r"\bjackets?\b", "jacket"),
    (r"\bsweatshirts?\b", "sweatshirt"),
    (r"\bbackpacks?\b", "backpack"),
    (r"\bhandbags?\b", "handbag"),
    (r"\bbags?\b", "bag"),
    (r"\bwallets?\b", "wallet"),
    (r"\bsandals?\b", "sandal"),
    (r"\bsports[\s\-]?sandals?\b", "sandal"),
    (r"\bheels?\b", "heel"),
    (r"\bflats?\b", "flat"),
    (r"\bshoes?\b", "shoe"),
    (r"\bcasual[\s\-]?shoes?\b", "shoe"),
    (r"\bsports[\s\-]?shoes?\b", "shoe"),
    (r"\bear[\s\-]?rings?\b", "earring"),
    (r"\bstuds?\b", "stud"),
    (r"\bhoops?\b", "hoop"),
    (r"\brings?\b", "ring"),
    (r"\bbangles?\b", "bangle"),
    (r"\bbracelets?\b", "bracelet"),
    (r"\bnecklaces?\b", "necklace"),
    (r"\bpendants?\b", "pendant"),
    (r"\bbras?\b", "bra"),
    (r"\bkurtis?\b", "kurti"),
    (r"\bkurtas?\b", "kurta"),
]
# H6: canonical term -> raw text variants ("tshirt" is listed twice in the
# reference; the later entry, without "tee", is the one in effect)
TERM_VARIANTS = {
    "tshirt": ["tshirt", "t-shirt", "t shirt", "tshirts", "t-shirts"],
    "trouser": ["trouser", "pant", "trousers", "pants", "chino", "chinos"],
    "jean": ["jean", "jeans", "denim"],
    "short": ["short", "shorts"],
    "skirt": ["skirt", "skirts"],
    "top": ["top", "tops"],
    "shirt": ["shirt", "shirts"],
    "jacket": ["jacket", "jackets", "blazer", "coat"],
    "sweatshirt": ["sweatshirt", "hoodie", "hoodies", "sweatshirts"],
    "backpack": ["backpack", "backpacks", "rucksack"],
    "handbag": ["handbag", "handbags", "purse"],
    "bag": ["bag", "bags", "tote"],
    "wallet": ["wallet", "wallets"],
    "sandal": ["sandal", "sandals"],
    "heel": ["heel", "heels"],
    "flat": ["flat", "flats"],
    "shoe": ["shoe", "shoes", "sneaker", "sneakers", "loafer", "loafers", "boot", "boots"],
    "earring": ["earring", "earrings", "ear ring", "stud", "studs", "hoop", "hoops"],
    "ring": ["ring", "rings"],
    "bangle": ["bangle", "bangles"],
    "bracelet": ["bracelet", "bracelets"],
    "necklace": ["necklace", "necklaces"],
    "pendant": ["pendant", "pendants"],
    "bra": ["bra", "bras", "lingerie"],
    "kurti": ["kurti", "kurtis", "kurta", "kurtas"],
    "perfume": ["perfume", "perfumes", "deodorant", "deo", "fragrance"],
    "watch": ["watch", "watches"],
    "dress": ["dress", "dresses", "gown"],
    "saree": ["saree", "sarees", "sari", "saris"],
    "legging": ["legging", "leggings", "tights"],
    "suit": ["suit", "suits"],
    "swimwear": ["swimwear", "swimsuit", "swimwear", "bikini"],
    "sock": ["sock", "socks"],
    "cap": ["cap", "caps", "hat", "hats"],
    "belt": ["belt", "belts"],
    "sunglasses": ["sunglass", "sunglasses", "eyewear"],
}
# E-mail shape
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
# H7: image values treated as missing
INVALID_IMAGE_VALUES = ["", "none", "nan", "null"]
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# H1 -------------------------------------------------------------------------
def brand_from_name(name, lower: bool = False) -> Column:
    """First whitespace token stripped of -_/., ; 'unknown' when nothing is left."""
    text = F.trim(F.coalesce(_c(name).cast("string"), F.lit("")))
    first = F.split(text, r"\s+").getItem(0)
    tok = F.regexp_replace(F.regexp_replace(first, r"^[-_/.,]+", ""), r"[-_/.,]+$", "")
    if lower:
        tok = F.lower(tok)
    return F.when(tok == "", F.lit("unknown")).otherwise(tok)


BRAND_SQL = ("coalesce(nullif(regexp_replace(regexp_replace(split_part(trim(coalesce({x}, '')), ' ', 1), "
             "'^[-_/.,]+', ''), '[-_/.,]+$', ''), ''), 'unknown')")


# H2 -------------------------------------------------------------------------
def type_from_name(name) -> Column:
    """Ordered keyword rules over ' lower(name) '; 'unknown' when none matches."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(_c(name).cast("string"), F.lit("")))),
                      F.lit(" "))
    expr = None
    for typ, kws in TYPE_KEYWORDS:
        cond = None
        for kw in kws:
            c = padded.contains(kw)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(typ)) if expr is None else expr.when(cond, F.lit(typ))
    blank = F.trim(F.coalesce(_c(name).cast("string"), F.lit(""))) == ""
    return F.when(blank, F.lit("unknown")).otherwise(expr.otherwise(F.lit("unknown")))


def type_from_name_sql(x: str) -> str:
    padded = f"(' ' || lower(trim(coalesce({x}, ''))) || ' ')"
    arms = []
    for typ, kws in TYPE_KEYWORDS:
        cond = " OR ".join(f"contains({padded}, '{kw}')" for kw in kws)
        arms.append(f"WHEN {cond} THEN '{typ}'")
    return f"(CASE WHEN trim(coalesce({x}, '')) = '' THEN 'unknown' {' '.join(arms)} ELSE 'unknown' END)"


# H3 -------------------------------------------------------------------------
def usable_text(col) -> Column:
    """lower(trim(x)) unless it is one of the missing markers (then NULL)."""
    v = F.lower(F.trim(_c(col).cast("string")))
    return F.when(v.isin(MISSING_TEXT) | v.isNull(), F.lit(None)).otherwise(v)


def product_type(*cols, name_col="product_name") -> Column:
    """First usable of the given columns, else the type inferred from the name."""
    inferred = type_from_name(name_col)
    return F.coalesce(*[usable_text(c) for c in cols], inferred)


def catalog_category(category_col, type_col) -> Column:
    """Raw category when usable, else a group derived from the product type."""
    t = _c(type_col)
    expr = None
    for group, types in CATEGORY_GROUPS:
        cond = t.isin(types)
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    derived = expr.when(t != "unknown", F.lit("apparel")).otherwise(F.lit("unknown"))
    return F.coalesce(usable_text(category_col), derived)


# H2 / H3, the app's variant -------------------------------------------------
def _first_of(value: Column, table: list[tuple[str, list[str]]], other: Column, contains: bool = False) -> Column:
    """Label of the first entry whose list holds ``value`` (or, with ``contains``, a part of it)."""
    expr = None
    for label, texts in table:
        hit = value.isin(texts)
        if contains:
            hit = F.lit(False)
            for t in texts:
                hit = hit | value.contains(t)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr.otherwise(other)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def title_case(text) -> Column:
    """Letters after a non-letter in upper case, all others in lower case."""
    def turn(chars: Column) -> Column:
        return F.array_join(F.transform(chars, lambda c, i: F.when(
            (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")
    return _bound(F.split(F.lower(_c(text)), ""), turn)


def app_type_label(value) -> Column:
    """Canonical label of a product type text, else the text in title case; blank: 'Unknown'."""
    raw = F.trim(F.coalesce(_c(value).cast("string"), F.lit("Unknown")))
    return _bound(F.when(raw == "", F.lit("Unknown")).otherwise(raw),
                  lambda x: _first_of(F.lower(x), APP_TYPE_LABELS, title_case(x)))


def app_type_from_name(name) -> Column:
    """Second rule set over the lower-cased name, as a label; 'Unknown' when none matches."""
    labels = {t: label for label, texts in APP_TYPE_LABELS for t in texts}
    table = [(labels.get(kind, kind.title()), words) for kind, words in APP_TYPE_KEYWORDS]
    return _first_of(F.lower(F.coalesce(_c(name).cast("string"), F.lit(""))), table, F.lit("Unknown"), contains=True)


def app_product_type(article_type, sub_category, category, name) -> Column:
    """First non-blank of article type, sub category and category (unless too broad), as a label, else by the name."""
    def given(c) -> Column:
        return F.nullif(F.trim(_c(c).cast("string")), F.lit(""))

    narrow = F.when(~F.lower(given(category)).isin(APP_BROAD_CATEGORIES), given(category))
    value = F.coalesce(given(article_type), given(sub_category), narrow)
    return F.when(value.isNull(), app_type_from_name(name)).otherwise(app_type_label(value))


def app_category_label(value) -> Column:
    raw = F.trim(F.coalesce(_c(value).cast("string"), F.lit("")))
    return F.when(F.lower(raw).isin(APP_CATEGORY_MISSING), F.lit("Unknown")).otherwise(
        _first_of(F.lower(raw), APP_CATEGORY_LABELS, raw))


def app_catalog_category(master_category, category, sub_category, type_label) -> Column:
    """First known of the three columns as a label, else the group of the type's label."""
    t = _c(type_label)
    derived = _first_of(t, APP_CATEGORY_GROUPS, F.when(t != "Unknown", F.lit("Apparel")).otherwise(F.lit("Unknown")))
    known = [F.nullif(app_category_label(c), F.lit("Unknown")) for c in (master_category, category, sub_category)]
    return F.coalesce(*known, derived)


# H4 / H5 --------------------------------------------------------------------
def normalize_search_text(text) -> Column:
    t = F.regexp_replace(F.lower(F.trim(_c(text))), r"\s+", " ")
    t = F.regexp_replace(t, BUDGET_PATTERN, "")
    t = F.regexp_replace(t, QUERY_STOPWORDS_PATTERN, "")
    for pat, rep in CANONICAL_TERMS:
        t = F.regexp_replace(t, pat, rep)
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_search_text_sql(x: str) -> str:
    t = f"regexp_replace(lower(trim({x})), '\\s+', ' ', 'g')"
    t = f"regexp_replace({t}, '{BUDGET_PATTERN}', '', 'g')"
    t = f"regexp_replace({t}, '{QUERY_STOPWORDS_PATTERN}', '', 'g')"
    for pat, rep in CANONICAL_TERMS:
        t = f"regexp_replace({t}, '{pat}', '{rep}', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def parse_budget(text) -> Column:
    """First 'under/below/less than/upto/up to [inr/rs/₹] NN..' amount, else NULL."""
    raw = F.regexp_extract(F.lower(_c(text)), BUDGET_PATTERN, 1)
    return F.when(raw == "", F.lit(None)).otherwise(raw).try_cast("int")


def parse_budget_sql(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(lower({x}), '{BUDGET_PATTERN}', 1), '') AS INTEGER)"


# H7 -------------------------------------------------------------------------
def normalize_image_url(raw, product_id, asset_base: str, bucket_host_pattern: str | None = None) -> Column:
    """Canonical image URL.

    blank/invalid -> by product id; an old bucket URL (``bucket_host_pattern``
    followed by the key) is rebuilt on ``asset_base``; http(s)/data URLs are
    kept; protocol-relative gets https; all digits -> '<digits>.jpg'; a path
    keeps its last segment when it has an extension.
    """
    base = asset_base.rstrip("/") + "/"
    cand = F.trim(F.coalesce(_c(raw).cast("string"), F.lit("")))
    cand = F.when(F.lower(cand).isin(INVALID_IMAGE_VALUES), F.lit("")).otherwise(cand)
    is_http = cand.startswith("http://") | cand.startswith("https://")
    cleaned = F.regexp_replace(F.regexp_replace(cand, r"\\", "/"), r"^/+|/+$", "")
    last = F.element_at(F.split(cleaned, "/"), -1)
    by_id = F.when(_c(product_id).isNotNull(),
                   F.concat(F.lit(base), _c(product_id).cast("string"), F.lit(".jpg"))).otherwise(F.lit(""))
    expr = F.when(F.lit(False), F.lit(""))
    if bucket_host_pattern:
        key = F.regexp_extract(cand, bucket_host_pattern + r"/(.*)$", 1)
        expr = F.when(is_http & (key != ""),
                      F.concat(F.lit(base), F.regexp_replace(F.regexp_replace(key, r"\\", "/"), "^/+", "")))
    return (expr.when(is_http | cand.startswith("data:image/"), cand)
            .when(cand.startswith("//"), F.concat(F.lit("https:"), cand))
            .when(cand.rlike(r"^[0-9]+$"), F.concat(F.lit(base), cand, F.lit(".jpg")))
            .when((cand != "") & last.contains("."), F.concat(F.lit(base), last))
            .otherwise(by_id))


def cache_busted(url, version: str) -> Column:
    u = _c(url)
    return (F.when(F.coalesce(u, F.lit("")) == "", F.lit(""))
            .when(u.contains("?"), F.concat(u, F.lit("&v=" + version)))
            .otherwise(F.concat(u, F.lit("?v=" + version))))


# H8 / H9 --------------------------------------------------------------------
def tracking_key(user, session, source, item) -> Column:
    """user|session|source|item, a NULL part written as the text 'None'."""
    parts = [F.coalesce(_c(x).cast("string"), F.lit("None")) for x in (user, session, source, item)]
    return F.concat_ws("|", *parts)


def safe_float(x) -> Column:
    return _c(x).try_cast("double")


def safe_int(x) -> Column:
    return _c(x).try_cast("double").try_cast("long")


# H12 / H13 ------------------------------------------------------------------
def hours_between(a, b) -> Column:
    """(b - a) in hours as double (microsecond exact)."""
    return (F.unix_micros(_c(b)) - F.unix_micros(_c(a))) / F.lit(3.6e9)


def time_decay(event_ts, now, decay: float = 0.995) -> Column:
    """decay ** |hours between|."""
    return F.pow(F.lit(decay), F.abs(hours_between(event_ts, now)))


def hours_since(event_ts, ref_ts) -> Column:
    return F.greatest(hours_between(event_ts, ref_ts), F.lit(0.0))


# H14 ------------------------------------------------------------------------
def cheapness(price, lo, hi) -> Column:
    """clip((hi - p) / (hi - lo), 0, 1) * 2 when the range is wide; else +1 for p > 0."""
    p, lo, hi = _c(price), _c(lo), _c(hi)
    wide = (hi - lo) > 0
    return (F.when(wide, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hi - p) / (hi - lo))) * 2.0)
            .when(p > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


# H16 / H17 ------------------------------------------------------------------
def price_text(price) -> Column:
    """'INR <int>' or 'N/A' for NULL / 0 / blank; non-numeric text shown as is."""
    raw = _c(price).cast("string")
    num = raw.try_cast("double")
    return (F.when(raw.isNull() | (F.trim(raw) == "") | (num == 0), F.lit("N/A"))
            .when(num.isNotNull(), F.concat(F.lit("INR "), num.cast("long").cast("string")))
            .otherwise(F.concat(F.lit("INR "), raw)))


def valid_email(email) -> Column:
    return F.lower(F.trim(_c(email))).rlike(EMAIL_PATTERN)
