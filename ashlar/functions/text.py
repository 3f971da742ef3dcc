"""Text cleaning, line predicates and normalisers as Catalyst expressions.

All take and return columns and stay inside the JVM; null counts as empty where
the behaviour to keep conflates the two. ``\\s`` is ASCII white space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, labels, words and patterns whose meaning results depend on.
GLYPHS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}
BASIC_GLYPHS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "ﬁ": "fi", "ﬂ": "fl", "�": "'"}
CHROME = r"^\s*(?:NOTES?|CAUTION|WARNINGS?|REMARKS?|HINT|TIPS?|IMPORTANT|DANGER|ATTENTION)\s*[:\-–—\s]*$"
FOLIO = r"^\s*(?:[-–—]\s*)?(?:page\s+)?[0-9]{1,4}(?:\s*(?:of|/)\s*[0-9]{1,4})?\s*(?:[-–—]\s*)?\s*$"
SQL_NO_ANSWER = ("%couldn't find%", "%could not find%", "%don't have%", "%do not have%", "%not covered in%", "%no relevant information%", "%i'm not finding%", "%i can't find%", "%outside%scope%", "%talk to a human%")
REGEX_NO_ANSWER = (
    r"couldn'?t find|could not find|don'?t have (?:that|this|the answer|enough info)|do not have (?:that|this|the answer)|passages? (?:don'?t|do not) cover|"
    r"not (?:in|covered in) (?:the )?(?:manuals?|docs?|documentation|context|excerpts?)|no (?:relevant )?information|i'?m not finding|i can'?t find|outside (?:the )?scope"
)
FUNCTION_WORDS = tuple(
    "the a an is are was were be been being of to in and or for on at with this that it as by from but not if so than into about before after during while until since "
    "through between below above over under such must should can will may shall have has had do does did".split()
)
UNITS = tuple(
    "liter litre liters litres ml cc cm mm m in inch inches ft ftlb lb kg g gram grams kw hp rpm nm ah v w watt watts amp amps volt volts psi bar kpa mpa ohm ohms teeth links "
    "deg degree degrees sec secs min mins hour hours ratio set sets pcs qty no nos dia dia. ea".split()
)
BODY_MARKERS = (
    "needs to be", "need to be", "should be", "must be", "following point", "the following", "as follows", "as shown", "before assembling", "before installing", "before removing",
    "after installing", "after assembling", "is required", "are required", "is recommended", "are recommended", "with respect to", "in order to", "in accordance with", "such that",
    " and the ", " or the ", " of the ", " for the ",
)
CONNECTORS = ("and", "or", "with", "for", "to", "of", "the", "a", "an", "in")
#: Words of which a recognised line of a manual holds at least one.
OCR_WORDS = (
    "the", "a", "an", "is", "are", "be", "been", "being", "of", "to", "in", "and", "or", "for", "on", "at", "with", "this", "that", "it", "as", "by",
    "from", "but", "not", "if", "then", "do", "does", "has", "have", "was", "were", "any", "no", "yes", "you", "we", "they", "all", "use", "see",
    "than", "such", "must", "should", "can", "will", "may", "shall", "into", "before", "after", "during", "while", "until", "since", "through",
    "between", "below", "above", "over", "under", "each", "per", "engine", "battery", "fuel", "oil", "air", "water", "system", "valve", "switch",
    "remove", "install", "replace", "tighten", "check", "inspect", "fluid", "filter", "spark", "plug", "fuse", "wire", "connector", "torque", "bolt",
    "nut", "screw", "washer", "level", "fill", "drain", "flush", "clean", "service", "lubricate", "adjust", "hex", "pin", "ring", "shaft", "gear",
    "bearing", "seal", "gasket", "cover", "frame", "wheel", "brake", "clutch", "chain", "sprocket", "head", "cylinder", "piston", "spec",
    "specification", "specifications", "rpm", "max", "min", "type", "ratio", "pressure", "temperature", "speed", "voltage", "current", "front",
    "rear", "left", "right", "side", "top", "bottom", "inside", "outside", "page", "section", "chapter", "figure", "fig", "note", "caution",
    "warning", "important", "model", "part", "code", "color", "yellow", "blue", "green", "red", "black", "white", "kit", "assembly", "lubrication",
    "lubricant", "consumables", "maintenance", "procedure", "instructions", "operation", "function", "component", "components", "parts", "tools",
    "tool", "year", "date", "time", "step", "steps", "mode", "modes", "fault", "diagnostic", "ignition", "starter", "sensor", "module", "controller",
    "harness", "coolant", "radiator", "exhaust", "intake", "throttle", "injector", "alternator", "regulator",
)


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def squash(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def replace_all(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)


def glyphs(c: Column) -> Column:
    return replace_all(c, GLYPHS)


def strip_pua(c: Column) -> Column:
    return F.regexp_replace(c, "[\\uE000-\\uF8FF]", " ")


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"([A-Za-z0-9_])-\n([a-z])", "$1$2")


def blank_collapse(c: Column) -> Column:
    """At most one blank line between lines, none at either end."""
    once = F.regexp_replace(c, r"\n([^\S\n]*\n)+", "\n\n")
    return F.regexp_replace(F.regexp_replace(once, r"^([^\S\n]*\n)+", ""), r"(^|\n)\s*$", "")


def clean_basic(c: Column) -> Column:
    lines = F.regexp_replace(replace_all(nz(c), BASIC_GLYPHS), r"[^\S\n]+\n", "\n")
    return strip(F.regexp_replace(lines, r"\n\n\n+", "\n\n"))


def cut_ocr(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("[OCR augment]")), rstrip(F.substring_index(c, "[OCR augment]", 1))).otherwise(c)


def cut_table(c: Column) -> Column:
    marker = r"(?:^|\n)[^\S\n]*\[Table\s+[0-9]+\][^\S\n]*(?:\n|$)"
    at = F.regexp_instr(c, F.lit(marker))
    return F.when(at > 0, rstrip(F.substr(c, F.lit(1), at - 1))).otherwise(c)


def clean_text(c: Column) -> Column:
    """The page chain: cuts, private-use strip, glyphs, dehyphenation, blank collapse (line filters run on lines)."""
    return blank_collapse(dehyphenate(glyphs(strip_pua(cut_table(cut_ocr(nz(c)))))))


def is_noise(line: Column) -> Column:
    """One non-alphanumeric character, or punctuation only; a blank line is none."""
    s = strip(line)
    return (s != "") & s.rlike(r"^[^A-Za-z0-9\x{80}-\x{10FFFF}]+$")


def is_chrome(line: Column) -> Column:
    return line.rlike(f"(?i){CHROME}")


def is_folio(line: Column) -> Column:
    return line.rlike(f"(?i){FOLIO}")


def match_tokens(c: Column) -> Column:
    split = F.split(F.lower(nz(c)), r"[\s,;:()/\\\-]+")
    return F.filter(F.transform(split, lambda x: F.regexp_replace(x, "^[.'\"]+|[.'\"]+$", "")), lambda x: x != "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def is_descriptive(line: Column) -> Column:
    s = strip(nz(line))
    return (F.length(s) >= 25) & s.rlike("[a-z]") & (F.size(words(s)) >= 4)


def is_body_sentence(body: Column) -> Column:
    s = strip(body)
    w = words(s)
    low = F.concat(F.lit(" "), F.lower(s), F.lit(" "))
    marked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in BODY_MARKERS])
    last = F.regexp_replace(F.lower(F.try_element_at(w, F.lit(-1))), "^[,;:.]+|[,;:.]+$", "")
    return (s != "") & ((F.size(w) > 8) | ((F.length(s) > 55) & (F.size(w) > 6)) | marked | F.coalesce(last.isin(*CONNECTORS), F.lit(False)))


def is_unit_body(body: Column) -> Column:
    w = F.transform(words(body), lambda x: F.regexp_replace(F.lower(x), "^[.:,;]+|[.:,;]+$", ""))
    return (F.size(w) == 0) | ((F.size(w) <= 2) & F.forall(w, lambda x: x.isin(*UNITS)))


def heading_case(c: Column) -> Column:
    """Words capitalised; short upper-case words stay; separators stay."""
    parts = F.regexp_extract_all(c, F.lit(r"([^\s/&\-]+|[\s/&\-])"), F.lit(1))
    fixed = F.transform(parts, lambda t: F.when((F.length(t) <= 4) & t.rlike("[A-Z]") & (F.upper(t) == t), t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))))
    return strip(F.array_join(fixed, ""))


def is_quality_ocr(line: Column) -> Column:
    """An OCR line that reads like text: few odd characters, enough letters, vowels, and a known word."""
    s = strip(line)
    n = F.length(s)
    odd = F.length(F.regexp_replace(s, r"[A-Za-z0-9\x{C0}-\x{24F}\s.,:;\-/&()'\[\]+%°×*#]", ""))
    letters = F.length(F.regexp_replace(s, r"[^A-Za-z\x{C0}-\x{24F}]", ""))
    long = F.regexp_extract_all(s, F.lit("([A-Za-z]{3,})"), F.lit(1))
    voiced = F.size(F.filter(long, lambda w: w.rlike("[aeiouyAEIOUY]")))
    known = F.exists(F.regexp_extract_all(F.lower(s), F.lit("([a-z]+)"), F.lit(1)), lambda w: w.isin(*OCR_WORDS))
    ratios = (odd * 5 <= n) & (letters * 100 >= n * 45) & ((F.size(long) == 0) | (voiced * 100 >= F.size(long) * 65))
    return (n >= 5) & ratios & ~s.rlike("(?i)[bcdfghjklmnpqrstvwxz]{5,}") & known


def no_answer_sql(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.ilike(c, F.lit(p)) for p in SQL_NO_ANSWER])


def no_answer_regex(c: Column) -> Column:
    return c.rlike(f"(?i)(?:{REGEX_NO_ANSWER})")


def is_sentence_header(headers: Column) -> Column:
    joined = F.lower(F.array_join(F.filter(F.transform(headers, strip), lambda x: x != ""), " "))
    w = F.regexp_extract_all(joined, F.lit("([a-z']+)"), F.lit(1))
    return (F.size(w) >= 4) & (F.size(F.filter(w, lambda x: x.isin(*FUNCTION_WORDS))) >= 2)


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(nz(c)), "[^a-z0-9]+", " "))


def norm_line(c: Column) -> Column:
    return F.trim(squash(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s\x{80}-\x{10FFFF}]", " ")))


def light_clean(c: Column) -> Column:
    fixed = F.regexp_replace(F.replace(nz(c), F.lit("�"), F.lit("±")), r"\.{8,}", "")
    return strip(F.regexp_replace(fixed, r"\n{4,}", "\n\n"))


def strip_section(c: Column) -> Column:
    return strip(F.regexp_replace(nz(c), r"(?im)^Section:[^\n]*\n+", ""))


def sanitize_section(c: Column) -> Column:
    s = strip(nz(c))
    return F.when(F.length(s) > 100, F.lit("")).otherwise(s)


def clean_title(c: Column) -> Column:
    return F.regexp_replace(nz(c), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")


def is_garbage_title(c: Column) -> Column:
    t = clean_title(c)
    kept = F.length(F.regexp_replace(t, r"[^A-Za-z0-9\x{C0}-\x{24F}]", ""))
    return (F.length(t) < 2) | (kept * 10 < F.length(t) * 4)


def image_title(c: Column) -> Column:
    return F.regexp_replace(squash(nz(c)), r"^[ .:;,\-_|]+|[ .:;,\-_|]+$", "")


def depipe(c: Column) -> Column:
    """Lines of a pipe-heavy text as ``a; b; c``."""
    lines = F.split(c, "\n")
    heavy = F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit(""))) >= 3 * F.size(lines)

    def line(x: Column) -> Column:
        many = F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2
        cells = F.filter(F.transform(F.split(x, r"\|"), strip), lambda y: y != "")
        return F.when(many, F.when(F.size(cells) > 0, F.array_join(cells, "; "))).otherwise(x)

    rebuilt = F.array_join(F.filter(F.transform(lines, line), lambda x: x.isNotNull()), "\n")
    return F.when(heavy, F.regexp_replace(rebuilt, r"[ \t]{2,}", " ")).otherwise(c)


def ground_norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s.\-_/]+", "")


def alias_norm(c: Column) -> Column:
    return F.translate(F.lower(strip(nz(c))), "_- ", "")


def query_key(c: Column) -> Column:
    return strip(squash(F.lower(nz(c))))


def safe_user(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(strip(nz(c)), "[^A-Za-z0-9_.-]+", "_"), F.lit("")), F.lit("default"))


def short_doc(c: Column) -> Column:
    """A file's label: no extension, revision or date tail, spaces for underscores, 36 characters."""
    bare = F.regexp_replace(F.regexp_replace(nz(c), r"(?i)\.pdf$", ""), r"(?i)[_\s-]*REV[-\s]?[0-9]+", "")
    return F.left(strip(F.replace(F.regexp_replace(bare, r"[_\s-]*[0-9]{1,2}[-_.][0-9]{1,2}[-_.][0-9]{2,4}$", ""), F.lit("_"), F.lit(" "))), F.lit(36))


def has_content(text: Column) -> Column:
    """A text chunk with 30 characters or more besides section and number lines."""
    return F.length(strip(F.regexp_replace(strip_section(text), r"(?m)^[^\S\n]*[0-9]{1,4}[^\S\n]*$", ""))) >= 30


def s3_key_norm(key: Column) -> Column:
    return F.array_join(F.filter(F.split(key, "/"), lambda s: ~s.isin("", "Data")), "/")


def embed_input(header: Column, body: Column) -> Column:
    return F.left(F.concat(header, F.lit("\n"), body), F.lit(30000))


def part_number_fix(c: Column) -> Column:
    """Part numbers without inner white space and with zeros for letter O.

    Every candidate is found with its text, squeezed, judged, and replaced in the
    whole text, in one fold over the candidates.
    """
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\b[A-Z]{1,3}[0-9][0-9A-Z\s]{5,19}[0-9A-Z])"), F.lit(1)))

    def put(text: Column, raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"\s+", "")
        good = F.length(bare).between(9, 18) & bare.rlike("^[A-Z]{1,3}[0-9]{3,}[0-9A-Z]*$")
        return F.when(good, F.replace(text, raw, F.replace(bare, F.lit("O"), F.lit("0")))).otherwise(text)

    return F.aggregate(found, c, put)


def phrase_fix(c: Column, table: dict[str, str]) -> Column:
    """Whole phrases replaced in any case, longest first; the first letter's case stays. Texts without any are left as they are."""
    out = c
    for phrase in sorted(table, key=len, reverse=True):
        right = table[phrase]
        for first in (str.lower, str.upper):
            out = F.regexp_replace(out, rf"\b{first(phrase[0])}(?i:{phrase[1:]})\b", first(right[0]) + right[1:])
    return F.when(c.rlike(r"(?i)\b(?:" + "|".join(sorted(table)) + r")\b"), out).otherwise(c)


#: Compounds that lose their fi, fl or ffi ligature in recognition.
LIGATURE_DROPS = {
    "speci c": "specific",
    "speci cally": "specifically",
    "speci cation": "specification",
    "speci cations": "specifications",
    "speci ed": "specified",
    "speci es": "specifies",
    "speci fy": "specify",
    "con rm": "confirm",
    "con rmed": "confirmed",
    "con rms": "confirms",
    "con rmation": "confirmation",
    "con guration": "configuration",
    "con gurations": "configurations",
    "con gured": "configured",
    "con dent": "confident",
    "con dence": "confidence",
    "con dential": "confidential",
    "de ne": "define",
    "de ned": "defined",
    "de nes": "defines",
    "de nition": "definition",
    "de nitions": "definitions",
    "identi cation": "identification",
    "identi ed": "identified",
    "identi es": "identifies",
    "veri ed": "verified",
    "veri es": "verifies",
    "veri cation": "verification",
    "modi cation": "modification",
    "modi cations": "modifications",
    "modi ed": "modified",
    "noti cation": "notification",
    "noti cations": "notifications",
    "noti ed": "notified",
    "classi cation": "classification",
    "classi ed": "classified",
    "quali cation": "qualification",
    "quali ed": "qualified",
    "recti cation": "rectification",
    "recti ed": "rectified",
    "recti er": "rectifier",
    "ampli er": "amplifier",
    "ampli cation": "amplification",
    "puri cation": "purification",
    "puri ed": "purified",
    "magni cation": "magnification",
    "magni ed": "magnified",
    "uni ed": "unified",
    "simpli ed": "simplified",
    "simpli cation": "simplification",
    "intensi ed": "intensified",
    "satis ed": "satisfied",
    "satis es": "satisfies",
    "noti er": "notifier",
    "puri er": "purifier",
    "humidi er": "humidifier",
    "intensi er": "intensifier",
    "ampli ers": "amplifiers",
    "bene t": "benefit",
    "bene ts": "benefits",
    "bene cial": "beneficial",
    "ef cient": "efficient",
    "ef ciency": "efficiency",
    "suf cient": "sufficient",
    "suf ciently": "sufficiently",
    "dif cult": "difficult",
    "dif culty": "difficulty",
    "ef cacy": "efficacy",
    "of cial": "official",
    "trafc": "traffic",
}

IMPERATIVES = tuple(
    "start stop connect disconnect check refer replace remove install adjust inspect read repeat press tighten loosen apply use note ensure set open close release verify "
    "measure wait switch turn do if when then before after".split()
)


def is_subtopic_body(body: Column) -> Column:
    """A sub-topic's title: two words or more, capital start, no instruction, no inner period but in initials."""
    w = words(body)
    first = F.regexp_replace(F.lower(F.try_element_at(w, F.lit(1))), "^[.,:;]+|[.,:;]+$", "")
    inner = F.contains(F.substr(body, F.lit(1), F.greatest(F.length(body) - 1, F.lit(0))), F.lit("."))
    good = F.length(body).between(5, 120) & (F.size(w) >= 2) & body.rlike("^[A-Z]") & ~F.coalesce(first.isin(*IMPERATIVES), F.lit(False))
    return good & (~inner | body.rlike(r"[A-Z]\.[A-Z]"))
