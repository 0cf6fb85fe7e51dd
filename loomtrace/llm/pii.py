"""Problem 4: personal information inside free text, found and replaced by typed placeholders.

Formats settle mail addresses, phone and identity numbers and street addresses. Names have no format. Here the
corpus decides: over all distinct texts of both fields it is counted in how many a capitalised term stands in a
context that introduces a person ("my name is ...") and in how many it stands anywhere. The ratio of these, as bits
above the corpus average, is what the term discloses about the protected entity; terms above ``DISCLOSURE`` bits
that are introduced in at least ``LEAST_CUED`` of their texts are protected, and a full name made of protected
terms is found in any context. Towns are learnt in the same way from complete addresses, which tells where an
address without post code ends. Terms must hold at least 1/``SHARE`` of all introductions, which bounds their number.

``sanitised_texts`` replaces what was found in both fields, leaving ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]``.

Defined results: null histories, null elements and null or invalid JSON give no rows; equal values of a row and
field are given once; a place that fits two types takes the first of the order of ``TYPES``.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "address", "id_number", "phone", "name")
DISCLOSURE = 3.0
SUPPORT = 3
SHARE = 200_000
#: Least share of the texts with a term that introduce it, where introductions are rare and bits come easily.
LEAST_CUED = 0.15
GAP = ""
NOTHING: list[tuple] = []

# Formats.
_TLD = r"(?:\.[\w-]+)*\.[A-Za-z]{2,}"
EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]+(?:@|\[@\]|\(@\)| ?\((?:at|AT)\) ?| ?\[(?:at|AT)\] ?)[\w-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[\w-]+)*(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z]{2,}(?![\w-])"
    r"|(?<![\w.+-])[\w.+-]+ at [\w-]+(?:(?: dot |\.)[\w-]+)* dot [A-Za-z]{2,}(?![\w-])"
    r"|(?<![\w.+-])(?=[\w.+-]*[._+\d-][\w.+-]* at )[\w.+-]+ at [\w-]+" + _TLD + r"(?![\w-])"
)
_STREET_END = r"(?:Street|Lane|Road|Avenue|Court|Drive|Way|Close|Square|Place|Terrace|Boulevard|Crescent|Row|Hill|Gardens|Walk|Mews|Alley|Parkway|Highway|St|Rd|Ave|Ln|Dr|Blvd)"
_STREET_BEGIN = (
    r"(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Cc]arrer|[Rr]onda|[Tt]ravesía|[Rr]ua|[Tt]ravessa|[Pp]raça|[Ll]argo|[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Vv]icolo|[Rr]ue|[Aa]llée|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Qq]uai|"
    r"Am|An der|Zum|Zur|Im|In der|Auf dem|улица|ул\.)"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_SMALL = r"(?:d[aeiou]s?|del|de la|de los|de las|du|des|della|dello|dei|delle|van|von|den|der|dem|la|le|les|los|las|el|l')"
_NUMBER = r"\d{1,5}(?:-\d{1,4})?(?: ?[a-zA-Z](?![\w'’]))?(?: (?:bis|ter))?"
_UNIT = r"(?:, (?:(?:Apt|Apartment|Flat|Unit|Suite|App)\.? ?\w+|\d{1,2}[ºª°]?(?:\.º)? ?(?:izq\.|dcha\.|dto\.|esq\.|[A-Za-z](?!\w))?|(?:esc\.|piso|puerta|int\.|bus|appt\.?) ?\w+))*"
_TCAP = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’])+(?!\w)"
_TOWN = rf"{_TCAP}(?:(?: |-)(?:{_SMALL} )?[A-ZÀ-ÖØ-Þ][a-zß-ÿ'’](?:[^\W\d_]|['’])*(?!\w))?"


def _code_first(group: str) -> str:
    return rf", (?:[A-Z]{{1,2}}-)?\d{{4,5}}(?: [A-Z]{{2}})? (?P<{group}>{_TOWN})"


ADDRESS = re.compile(
    "|".join(
        (
            rf"(?<![\w.-])(?:(?:Flat|Unit|Apt|Apartment) \w+, )?{_NUMBER} (?:{_CAP} ){{1,3}}{_STREET_END}\b{_UNIT}, (?P<t1>{_TOWN})(?P<z1>,? [A-Z]{{2}} ?\d{{5}}|,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}|,? \d{{5}})?",
            rf"(?<![\w.-]){_NUMBER} {_STREET_BEGIN} (?:{_SMALL} ?)?{_CAP}(?: (?:{_SMALL} )?{_CAP}){{0,3}}{_UNIT}" + _code_first("t2"),
            rf"(?<!\w){_STREET_BEGIN} (?:{_SMALL} ?)?{_CAP}(?: (?:{_SMALL} )?{_CAP}){{0,3}},? {_NUMBER}{_UNIT}" + _code_first("t3"),
            rf"(?<!\w){_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig|pfad|hof|straat|laan|plein|gracht|kade|dijk|dreef) {_NUMBER}{_UNIT}" + _code_first("t4"),
        )
    )
)
ID_NUMBER = re.compile(
    r"(?<![\w-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]{2}\d{7}"
    r"|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"
    r"|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}"
    r")(?![\w]|-\w|[.,]\d)"
)
ID_CUE = re.compile(
    r"(?i:passport|identity|social security|national insurance|insurance|tax|ausweis\w*|steuer-?id|pass(?:nummer)?|sozialversicherungs\w*|passeport|identité|sécurité sociale|pasaporte|identidad|dni|nif|passaporto|codice fiscale|"
    r"passaporte|identidade|cpf|paspoort\w*|bsn|identiteits\w*|паспорта?|снилс|инн|护照|身份证|\bid)(?: ?(?i:number|no\.?|nr\.?|nummer|número|numero|numéro|号码|号|card))?[^\w\n]{0,4}(?i:is|ist|lautet|est|es|è|é|是|number|:|nummer)?[^\w\n]{0,3}"
    r"(?P<n>(?=[A-Z0-9 .-]*\d{3})[A-Z0-9](?:[A-Z0-9]|[ .-](?=[A-Z0-9]*\d)|[ .-](?=[A-Z](?!\w))){5,19})(?![\w])"
)
PHONE = re.compile(
    r"(?<![\w+.,/=-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}(?:-\d{1,5})?"
    r"|\(\d{2,5}\) ?\d{3,5}[ .-]\d{3,5}(?:[ -]\d{1,4})?"
    r"|1[- .]\d{3}[- .]\d{3}[- .]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|0\d(?:\.\d{2}){4}"
    r"|00\d{2} \d{1,5}[ -]\d{3,9}(?:[ -]\d{1,5})?"
    r"|0\d{1,4}(?:[ -]\d{2,8}){1,4}"
    r"|[6789]\d{2}(?: \d{2}){3}|[6789]\d{2} \d{3} \d{3}"
    r")(?![\w]|[.,-]\d)"
)
NO_PERSON = re.compile(r"(?i:order|invoice|isbn|build|version|server|table|page|flight|ref|reference|ticket|model|serial|article|item|bestellung|rechnung|pedido|factura|commande|facture|заказ|订单|ip|tracking)[ .:#№]*(?:no\.? ?|nr\.? ?)?$")
_FIRST = rf"{_CAP}(?:-{_CAP})?"
NAME = rf"(?:(?P<first>[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?)(?P<mid>(?: [A-Z]\.)*) (?P<last>[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?)|(?P<last2>[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?), (?P<first2>[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?)(?P<mid2>(?: [A-Z]\.)*))"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Sr|Sra|Dra|Sig|Mme|M|Dhr|Mevr)\.? )*"
CUES = (
    r"[Mm]y name is|[Ii] am called|[Oo]n behalf of|[Rr]egards,|[Rr]eply to|[Mm]y (?:landlady|landlord|neighbour|doctor|boss|teacher|sister|brother|colleague|friend|aunt|uncle|lawyer)|\([Ff]or|[Ss]incerely,|[Yy]ours,|[Bb]est,|"
    r"[Ii]ch heiße|[Mm]ein Name ist|Grüße,|Grüßen,|[Mm]eine? (?:Ärztin|Arzt|Nachbarin|Nachbar|Kollegin|Kollege|Chefin|Chef|Vermieterin|Vermieter)|[Jj]e m'appelle|[Mm]on nom est|[Cc]ordialement,|[Mm]e llamo|[Mm]i nombre es|[Ss]aludos,|"
    r"[Mm]i chiamo|[Ii]l mio nome è|[Ss]aluti,|[Oo] meu nome é|[Cc]hamo-me|[Cc]umprimentos,|[Aa]braços,|[Ii]k heet|[Mm]ijn naam is|[Gg]roeten,|[Gg]roet,|[Мм]еня зовут|[Мм]оё имя|уважением,|我的名字是|我叫|此致，?"
)
INTRODUCED = re.compile(rf"(?:{CUES})\s*{_TITLE}{NAME}")
ANY_NAME = re.compile(rf"(?<![\w-]){NAME}(?!\w)")
_PAIR = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'’]+(?: [A-Z]\.)*,? [A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")
_TERM = re.compile(r"(?<![\w@.-])[A-ZÀ-ÖØ-Þ][\w'’]+(?![\w@])")


def form(word: str) -> str:
    """A term as it is counted: words in capitals count with their ordinary spelling."""
    return word.capitalize() if len(word) > 1 and word.isupper() else word


@dataclass
class Lexicon:
    """Protected terms with the bits they disclose, and the towns of complete addresses."""

    bits: dict[str, float]
    towns: frozenset[str]

    def protects(self, part: str) -> bool:
        return all(form(p) in self.bits for p in part.split("-"))


def _town_of(m: re.Match) -> tuple[str, str | None]:
    """Name of the group and the town of an address."""
    g = next(k for k in ("t1", "t2", "t3", "t4") if m.group(k))
    return g, m.group(g)


def _introduced(t: str) -> set[tuple[str, str]]:
    """(kind, term) of the terms that a text introduces and of the towns of its complete addresses."""
    out: set[tuple[str, str]] = set()
    if _PAIR.search(t):
        for m in INTRODUCED.finditer(t):
            for g in ("first", "last", "first2", "last2"):
                out.update(("cue", form(p)) for p in (m.group(g) or "").split("-") if len(p) > 1)
    if _DIGIT.search(t):
        for m in ADDRESS.finditer(t):
            g, town = _town_of(m)
            if (g != "t1" or m.group("z1")) and re.match(r"[\s]*(?:[.,;。)]|$|[a-z])", t[m.end() :]):
                out.add(("town", town))
    return out


def _per_text(turns: DataFrame, history: str, msgs: str, rows: Callable[[str], list[tuple]], schema: str, every: bool) -> DataFrame:
    """``rows`` of the texts of both fields with a hash of the text: of every occurrence, or at least once for each text."""
    names = ["h", *(c.split()[0] for c in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list[tuple]] = {}
        for f in frames:
            out: list[tuple] = []
            for history, msgs in zip(f["h"], f["m"].tolist()):
                for t in (*(history if history is not None else ()), *message_texts(msgs)):
                    if not t:
                        continue
                    h = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    got = seen.get(h)
                    if got is None:
                        if len(seen) > 300_000:
                            seen.clear()
                        got = rows(t)
                        seen[h] = got if every and got else NOTHING
                    elif not got:
                        continue
                    out.extend((h, *x) for x in got)
            yield pd.DataFrame(out, columns=names)

    m = F.col(msgs) if msgs in turns.columns else F.lit(None).cast("string")
    return turns.select(F.col(history).alias("h"), m.alias("m")).mapInPandas(run, f"h bigint, {schema}")


def learn(turns: DataFrame, history: str = "user_msg_history", msgs: str = "turn_msgs") -> Lexicon:
    """Count over both fields: the ratios over distinct texts, ``SUPPORT`` and ``SHARE`` over occurrences. What comes back is bounded by 1/SHARE of the introductions (terms) and of the addresses (towns)."""
    introduced = _per_text(turns, history, msgs, lambda t: list(_introduced(t)), "kind string, term string", every=True)
    by_text = introduced.groupBy("kind", "term", "h").agg(F.count("*").alias("n"))
    per = by_text.groupBy("kind", "term").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    sums = per.groupBy("kind").agg(F.sum("n").alias("all_n"), F.sum("texts").alias("all_texts"))  # two rows, over the same shuffle
    kept = per.join(F.broadcast(sums), "kind").filter((F.col("n") >= SUPPORT) & (F.col("n") >= F.col("all_n") / SHARE)).collect()
    cued_texts = {r.kind: r.all_texts for r in kept}
    cue = {r.term: r.texts for r in kept if r.kind == "cue"}
    places = {r.term: r.n for r in kept if r.kind == "town"}
    shared = turns.sparkSession.sparkContext.broadcast(frozenset(cue))

    def standing(t: str) -> list[tuple[str | None, int]]:
        terms = {form(w) for w in _TERM.findall(t)}
        return [(None, len(terms)), *((w, 1) for w in terms & shared.value)] if terms else []

    bits: dict[str, float] = {}
    if cue:
        counted = _per_text(turns, history, msgs, standing, "term string, n bigint", every=False).groupBy("h", "term").agg(F.max("n").alias("n")).groupBy("term").agg(F.sum("n").alias("n"))
        everywhere = {r.term: r.n for r in counted.collect()}
        average = cued_texts["cue"] / max(everywhere.pop(None, 0), 1)
        bits = {w: b for w, n in everywhere.items() if (b := math.log2(cue[w] / n / average)) >= DISCLOSURE and cue[w] >= LEAST_CUED * n}
    # a "town" of two words whose first word is a commoner town has swallowed the word after it
    return Lexicon(bits, frozenset(t for t, n in places.items() if places.get(t.split()[0], 0) <= n))


def _trim_town(m: re.Match, lexicon: Lexicon) -> int:
    """End of an address: a town of two words without a post code after it may have swallowed the next sentence."""
    g, town = _town_of(m)
    if g == "t1" and m.group("z1"):
        return m.end()
    if town in lexicon.towns:
        return m.end()
    head = re.match(_CAP, town).group()
    if len(head) < len(town) and (head in lexicon.towns or town.split()[-1] in _OPENERS):
        return m.start(g) + len(head)
    return m.end()


# Words that begin a sentence and so end a town or a name before them.
_OPENERS = frozenset(
    "What How Why Which Is Are Could Can Give Tell Find Please List Summarise I My The Do Does Did We Our It You In For Most If When Where Who Send Copy Call One New Just Hey Hi Honestly Before As This That Regards Flight Order Invoice Page They Links Use Keep Mention No A An "
    "Was Wie Wo Welche Gibt Kannst Bitte Ich Mein Meine Que Qué Cuál Dónde Hay Puedes Dame Necesito He Quelle Où Est Peux Donne Je Mon Che Dove Qual Ci Mi Dammi Ho Vorrei O Qual Onde Há Você Dê Li Preciso Wat Is Kun Geef Ik Mijn Welke".split()
)


def find(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, type) of each finding, without overlaps, in order of place."""
    found: list[tuple[int, int, str]] = []
    digits = any(c.isdigit() for c in text)

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    def add(a: int, b: int, kind: str) -> None:
        if a < b and free(a, b):
            found.append((a, b, kind))

    if "@" in text or "at" in text or "AT" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if digits:
        for m in ADDRESS.finditer(text):
            add(m.start(), _trim_town(m, lexicon), "address")
        for m in ID_NUMBER.finditer(text):
            if not NO_PERSON.search(text[max(0, m.start() - 24) : m.start()]):
                add(m.start(), m.end(), "id_number")
        for m in ID_CUE.finditer(text):
            if not PHONE.fullmatch(m.group("n")):
                add(m.start("n"), m.end("n"), "id_number")
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 8 <= n <= 15 and not NO_PERSON.search(text[max(0, m.start() - 24) : m.start()]):
                add(m.start(), m.end(), "phone")
    if not _PAIR.search(text):
        return sorted(found)
    for m in INTRODUCED.finditer(text):
        first, last = m.group("first") or m.group("first2"), m.group("last") or m.group("last2")
        if m.group("first2") and not (lexicon.protects(first) and lexicon.protects(last)):
            continue
        if first in _OPENERS or last in _OPENERS:
            continue
        add(m.start("first") if m.group("first") else m.start("last2"), m.end("last") if m.group("last") else m.end("mid2"), "name")
    at = 0 if any(form(w) in lexicon.bits for w in _TERM.findall(text)) else len(text)
    while m := ANY_NAME.search(text, at):
        first, last = m.group("first") or m.group("first2"), m.group("last") or m.group("last2")
        if lexicon.protects(first) and lexicon.protects(last):
            add(m.start(), m.end(), "name")
            at = m.end()
        else:
            at = m.start() + len(re.match(r"[\w'’-]+", m.group()).group())
    return sorted(found)


def sanitised(text: str | None, lexicon: Lexicon) -> str | None:
    """The text with a typed placeholder in place of each finding."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text, lexicon):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def text_values(value) -> Iterator[str]:
    """All text values of decoded JSON; text that is itself JSON is decoded in turn."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            if v[:1] in "[{" and len(v) > 2:
                try:
                    stack.append(json.loads(v))
                    continue
                except (ValueError, RecursionError):
                    pass
            yield v
        elif isinstance(v, dict):
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)


# One web address or message id and nothing else.
_BARE = re.compile(r"https?://[!-~]*|msg_[\w-]*", re.A)


def _worth(v: str) -> bool:
    return len(v) > 4 and not _BARE.fullmatch(v)


def message_texts(msgs: str | None) -> Iterator[str]:
    """The text values of a field of JSON that can hold personal information; none where it is null or invalid."""
    try:
        values = json.loads(msgs) if msgs is not None else None
    except (ValueError, RecursionError):
        return
    yield from filter(_worth, text_values(values))


def findings(turns: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Distinct (row_id, field_name, pii_type, pii_text) of both fields."""
    kind = dict(turns.dtypes)["row_id"]
    shared = turns.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        for f in frames:
            out: list[tuple] = []
            known: dict[str, list[tuple[str, str]]] = {}

            def of(text: str) -> list[tuple[str, str]]:
                if len(known) > 100_000:
                    known.clear()
                hit = known.get(text)
                if hit is None:
                    hit = known[text] = [(k, text[a:b]) for a, b, k in find(text, lex)]
                return hit

            for key, history, msgs in zip(f["row_id"].tolist(), f["h"], f["m"].tolist()):
                if history is not None:
                    out.extend((key, "user_msg_history", *x) for x in dict.fromkeys(x for t in history if t for x in of(t)))
                out.extend((key, "turn_msgs", *x) for x in dict.fromkeys(x for t in message_texts(msgs) for x in of(t)))
            yield pd.DataFrame(out, columns=["row_id", "field_name", "pii_type", "pii_text"])

    slim = turns.select("row_id", F.col("user_msg_history").alias("h"), F.col("turn_msgs").alias("m"))
    return slim.mapInPandas(run, f"row_id {kind}, field_name string, pii_type string, pii_text string")


# A text of JSON in its raw form (perhaps cut off), and how JSON of lists, objects and texts begins.
_LITERAL = re.compile(r'"(?P<raw>[^"\\]*(?:\\.[^"\\]*)*)(?P<end>"(?P<key>\s*:)?|\\?\Z)', re.S)
_HALF = re.compile(r"\\u[0-9A-Fa-f]{0,3}\Z")
_JSON_BEGIN = re.compile(r'\s*(?:\[\s*)*(?:\{\s*(?:["}]|\Z)|["\]]|null|\Z)')


def _json_with(text: str, clean: Callable[[str], str]) -> str:
    """JSON text with ``clean`` applied to the text values of ``text_values``; all else, also a cut-off end, stays as written."""

    def one(m: re.Match) -> str:
        raw, rest = m.group("raw"), ""
        if m.group("key") is not None:
            return m.group()
        value = raw
        if "\\" in raw:
            try:
                value = json.loads(f'"{raw}"', strict=False)
            except ValueError:
                half = _HALF.search(raw)
                raw, rest = (raw[: half.start()], half.group()) if half else (raw, "")
                try:
                    value = json.loads(f'"{raw}"', strict=False)
                except ValueError:
                    return f'"{clean(raw)}{rest}{m.group("end")}'
        new = _value_with(value, clean)
        return m.group() if new == value else json.dumps(new, ensure_ascii="\\u" in raw)[:-1] + rest + m.group("end")

    return _LITERAL.sub(one, text)


def _value_with(value: str, clean: Callable[[str], str]) -> str:
    if value[:1] in "[{" and len(value) > 2:
        try:
            json.loads(value)
            return _json_with(value, clean)
        except (ValueError, RecursionError):
            pass
    return clean(value)


def sanitised_json(text: str, clean: Callable[[str], str]) -> str:
    """A field of JSON text with ``clean`` applied to every text value; text that is no JSON at all is one text value."""
    return _json_with(text, clean) if _JSON_BEGIN.match(text) else _value_with(text, clean)


def sanitised_texts(turns: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(row_id, field_name, pos, text) with placeholders: each element of the histories (null elements stay null) and,
    as position 0, the JSON of ``turn_msgs``. JSON that is cut off keeps its end; its texts are searched all the same."""
    kind = dict(turns.dtypes)["row_id"]
    shared = turns.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, known = shared.value, {}

        def of(text: str) -> str:
            if len(known) > 100_000:
                known.clear()
            hit = known.get(text)
            if hit is None:
                hit = known[text] = sanitised(text, lex)
            return hit

        def value(text: str) -> str:
            return of(text) if _worth(text) else text

        for f in frames:
            out: list[tuple] = []
            for key, history, msgs in zip(f["row_id"].tolist(), f["h"], f["m"].tolist()):
                if history is not None:
                    out.extend((key, "user_msg_history", i, of(t) if t else t) for i, t in enumerate(history))
                if msgs is not None:
                    out.append((key, "turn_msgs", 0, sanitised_json(msgs, value)))
            yield pd.DataFrame(out, columns=["row_id", "field_name", "pos", "text"])

    slim = turns.select("row_id", F.col("user_msg_history").alias("h"), F.col("turn_msgs").alias("m"))
    return slim.mapInPandas(run, f"row_id {kind}, field_name string, pos int, text string")
