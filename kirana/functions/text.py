"""Text, money and audio rules as Column expressions.

All are built-in Spark expressions (regex, higher-order array functions,
JSON functions), so they run inside whole-stage codegen on the JVM.
Regexes use ``\\p{..}`` classes where Python's Unicode-aware ``\\w``/``\\d``
semantics must be matched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kirana.functions.phone import py_strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's word lists for equal results)
# ---------------------------------------------------------------------------

# Search stop words, English then Kannada script then romanised Kannada.
STOP_WORDS = [
    "i", "want", "to", "make", "a", "an", "the", "some", "need", "for",
    "please", "get", "give", "and", "of", "in", "with", "buy", "order",
    "item", "items", "stuff", "product", "products", "do", "you", "have", "can", "me",
    "ನನಗೆ", "ಬೇಕು", "ದಯವಿಟ್ಟು", "ಮತ್ತು", "ಒಂದು", "ಎರಡು", "ಸ್ವಲ್ಪ", "ತಂದುಕೊಡಿ", "ಕೊಡಿ",
    "nanage", "beku", "dayavittu", "matthu", "ondu", "eradu", "kodi",
]

# Terms that also match the category column in catalog search.
CATEGORY_WORDS = ["dairy", "bakery", "snacks", "beverages", "produce",
                  "household", "personal care", "groceries", "eggs"]

# Unit words ignored when resolving an item name to a product.
UNIT_WORDS = ["liter", "litre", "1l", "1kg", "kg", "packet", "pack"]

# Greetings answered on the fast path, and those that may name the assistant.
GREETINGS = ["hello", "hi", "hey", "ಹಲೋ", "ನಮಸ್ಕಾರ", "ಯಾರಿದ್ದೀರಿ"]
NAMING = ["hello", "hi", "ಹಲೋ"]

# Fixed value: characters a transcript may consist of and still be empty.
PUNCT_ONLY = r"^[.,!?_ :;-]*$"

# What S5 replaces, and by what; patterns and order decide the result.
CLEAN_STEPS = [
    (r"```(?:json)?\s*[\s\S]*?```", ""),
    (r"\{[\s\S]*?\}", ""),
    (r"\[[\s\S]*?\]", ""),
    (r'"[a-zA-Z0-9_-]+"\s*:\s*"[^"]*"', ""),
    (r'"[a-zA-Z0-9_-]+"\s*:\s*[\p{Nd}.]+', ""),
    (r"[{}\[\]\"']", ""),
    (r"[*#_`~]", ""),
    (r"[^\x00-\x7F\x{0C80}-\x{0CFF}]+", " "),
    (r"\s*,\s*,+", ", "),
    (r"^[,.\s\-_]+", ""),
    (r"[,;\s\-_]+$", ""),
    (r"\s+", " "),
]

# Hosts that are the machine itself, and marks of a secure link elsewhere.
LOCAL_HOSTS = ["localhost", "127.0.0.1"]
SECURE_HOSTS = ["ngrok", "cloudflare", "onrender.com"]

WORD = r"[\p{L}\p{N}_]+"

# ---------------------------------------------------------------------------


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_text(text: Column) -> Column:
    """Strip JSON blocks/objects/lists, key:value remnants, quotes, markdown,
    non-ASCII non-Kannada runs; tidy commas and spaces."""
    t = F.coalesce(text, F.lit(""))
    for pat, rep in CLEAN_STEPS:
        t = F.regexp_replace(t, pat, rep)
    return F.trim(t)


def is_repetitive(text: Column) -> Column:
    """Empty / shorter than 2 characters after stripping, or a character run of 5+."""
    s = py_strip(F.coalesce(text, F.lit("")))
    return (F.length(s) < 2) | s.rlike(r"(.)\1{4,}")


def strip_cjk(text: Column) -> Column:
    """Drop CJK / Hangul runs, then leading punctuation and outer whitespace."""
    t = F.regexp_replace(text, r"[\u3000-\u9FFF\uAC00-\uD7AF]+", "")
    return py_strip(F.regexp_replace(t, r"^[,.\s\-_]+", ""))


def search_tokens(query: Column) -> Column:
    """Word tokens of the lower-cased, stripped query (Python ``\\w`` semantics)."""
    return F.regexp_extract_all(F.lower(py_strip(query)), F.lit(WORD), 0)


def search_terms(query: Column) -> Column:
    """Tokens minus stop words and 1-char tokens; if none, keep the 1-char ones."""
    toks = search_tokens(query)
    stop = _lit_array(STOP_WORDS)
    keep = F.filter(toks, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))
    loose = F.filter(toks, lambda w: ~F.array_contains(stop, w))
    return F.array_distinct(F.when(F.size(keep) > 0, keep).otherwise(loose))


def significant_tokens(name: Column) -> Column:
    """Whitespace tokens longer than 1, not all digits, not a unit word."""
    toks = F.filter(F.split(py_strip(name), r"\s+"), lambda t: t != "")
    units = _lit_array(UNIT_WORDS)
    return F.filter(toks, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{Nd}+$")
                    & ~F.array_contains(units, F.lower(t)))


def safe_quantity(q: Column, floor_one: bool = True) -> Column:
    """Integer text of any length -> bigint (beyond its range the nearest
    bigint), else 1; with ``floor_one`` values <= 0 become 1."""
    s = py_strip(q.cast("string"))
    edge = F.when(s.startswith("-"), F.lit(-2**63)).otherwise(F.lit(2**63 - 1))
    n = F.when(s.rlike(r"^[+-]?[0-9]+$"), F.coalesce(s.try_cast("bigint"), edge)).otherwise(F.lit(1).cast("bigint"))
    return F.when(n <= 0, F.lit(1)).otherwise(n) if floor_one else n


def money_round(x: Column) -> Column:
    """Round money to 2 decimals in decimal arithmetic."""
    return F.round(x.cast("decimal(38,6)"), 2).cast("double")


def delivery_fee(delivery_type: Column, subtotal: Column, fee: Column, threshold: Column) -> Column:
    """No fee for pickup or when the subtotal reaches the threshold."""
    return (F.when(F.lower(delivery_type) != "delivery", F.lit(0.0))
            .when(subtotal >= threshold, F.lit(0.0)).otherwise(fee))


def eta_window(base_ts: Column, minutes: Column) -> Column:
    """S4: "{m-5} to {m+5} minutes (approx h:mm AM)" from a base timestamp column."""
    arrive = base_ts + F.make_interval(mins=minutes)
    return F.format_string("%d to %d minutes (approx %s)", minutes - 5, minutes + 5,
                           F.date_format(arrive, "h:mm a"))


def order_ref(key: Column, prefix: str = "ORD") -> Column:
    """Stable order reference: prefix + 12 upper-case hex digits of SHA-256(key)."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 12)))


def address_default(delivery_type: Column, given: Column, registered: Column) -> Column:
    """Delivery without an address takes the registered one; no address -> 'Store Pickup'."""
    g = F.nullif(given, F.lit(""))
    addr = F.when((F.lower(delivery_type) == "delivery") & g.isNull(), F.nullif(registered, F.lit(""))).otherwise(g)
    return F.coalesce(addr, F.lit("Store Pickup"))


def name_default(given: Column, registered: Column) -> Column:
    """Empty caller name -> profile name -> 'Valued Customer'."""
    return F.coalesce(F.nullif(py_strip(given), F.lit("")), F.nullif(registered, F.lit("")),
                      F.lit("Valued Customer"))


def greeting_intent(text: Column, assistant: tuple[str, ...] = ()) -> Column:
    """Lower-cased, stripped, '?!.' removed, equal to a known greeting, alone or with
    one of the ``assistant``'s names (in small letters)."""
    norm = F.translate(F.lower(py_strip(text)), "?!.", "")
    return norm.isin(*GREETINGS, *[f"{g} {name}" for g in NAMING for name in assistant])


def greeting_text(customer_name: Column, store_name: Column, template: Column) -> Column:
    """Per-caller greeting: named for registered callers, generic otherwise."""
    base = F.replace(template, F.lit("{store_name}"), store_name)
    return F.when(customer_name.isNotNull(), F.concat(base, F.lit(" Hello "), customer_name, F.lit(".")))\
        .otherwise(F.concat(base, F.lit(" Please tell us your name and address.")))


def has_kannada(text: Column) -> Column:
    """Text contains a character of the Kannada block U+0C80-U+0CFF."""
    return text.rlike(r"[\u0C80-\u0CFF]")


def boxcar_downsample(arr: Column, n: int = 3) -> Column:
    """Mean of each run of ``n`` samples, remainder dropped (double precision)."""
    k = F.floor(F.size(arr) / n).cast("int")
    idx = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))

    def mean_at(i: Column) -> Column:
        total = F.lit(0.0)
        for j in range(n):
            total = total + F.element_at(arr, i * n + (j + 1)).cast("double")
        return total / n
    return F.transform(idx, mean_at)


def rms(arr: Column) -> Column:
    """Root mean square of an audio chunk (double precision, 0 for empty)."""
    sq = F.aggregate(F.transform(arr, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                     lambda a, b: a + b)
    return F.when(F.size(arr) > 0, F.sqrt(sq / F.size(arr))).otherwise(F.lit(0.0))


def scheme_flag(url: Column, local: list[str] = LOCAL_HOSTS, secure: list[str] = SECURE_HOSTS) -> Column:
    """S23: 'ws' for a link to a ``local`` host, unless it says https or its host has a ``secure`` mark; else 'wss'."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)

    def has(marks: list[str]) -> Column:
        return F.exists(_lit_array(marks), lambda m: host.contains(m))
    plain = has(local) & ~has(secure) & ~url.contains("https")
    return F.when(~plain, F.lit("wss")).otherwise(F.lit("ws"))


# -- tool calls ---------------------------------------------------------------

# Fixed value: the fence that models put around JSON.
FENCED = r"```(?:json)?\s*(\{[\s\S]*?\})\s*```"
# One level of nesting; possessive quantifiers keep Java's matcher linear.
BALANCED = r"(\{(?:[^{}]++|\{[^{}]*+\})*+\})"


def _has_key(j: Column, *keys: str) -> Column:
    ks = F.json_object_keys(j)
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.coalesce(F.array_contains(ks, k), F.lit(False))
    return cond


def extract_tool_json(text: Column) -> Column:
    """The tool-call JSON object in a model reply, or NULL.

    Fenced ```json {...}``` with a tool/name key first; else the first
    balanced object with tool/name and arguments/parameters/query."""
    fenced = F.regexp_extract(text, FENCED, 1)
    fenced_ok = (fenced != "") & _has_key(fenced, "tool", "name")
    cands = F.regexp_extract_all(text, F.lit(BALANCED), 1)
    raw = F.filter(cands, lambda m: _has_key(m, "tool", "name")
                   & _has_key(m, "arguments", "parameters", "query"))
    return F.when(fenced_ok, fenced).otherwise(F.try_element_at(raw, F.lit(1)))


def tool_name(j: Column) -> Column:
    return F.coalesce(F.get_json_object(j, "$.tool"), F.get_json_object(j, "$.name"))


def tool_arguments(j: Column) -> Column:
    return F.coalesce(F.get_json_object(j, "$.arguments"), F.get_json_object(j, "$.parameters"),
                      F.get_json_object(j, "$.query"))


def normalize_items(items_json: Column) -> Column:
    """Items given as a JSON list whose elements are objects ({name, quantity})
    or strings (quantity 1); other elements are skipped, and JSON that is not a
    list has no items.  Text that is not JSON is one item named by the text."""
    whole = F.try_parse_json(items_json)
    elems = F.try_variant_get(whole, "$", "array<variant>")

    def kind(e: Column) -> Column:
        return F.schema_of_variant(e)

    def one(e: Column) -> Column:
        is_obj = kind(e).startswith("OBJECT")
        name = F.when(is_obj, F.coalesce(F.try_variant_get(e, "$.name", "string"), F.lit(""))).otherwise(F.try_variant_get(e, "$", "string"))
        qty = F.when(is_obj, F.coalesce(F.try_variant_get(e, "$.quantity", "string"), F.lit("1"))).otherwise(F.lit("1"))
        return F.struct(name.alias("name"), qty.alias("quantity"))
    usable = F.filter(elems, lambda e: (kind(e) == "STRING") | kind(e).startswith("OBJECT"))
    fallback = F.array(F.struct(items_json.alias("name"), F.lit("1").alias("quantity")))
    return (F.when(whole.isNull(), fallback)
            .otherwise(F.coalesce(F.transform(usable, one), F.filter(fallback, lambda _: F.lit(False)))))
