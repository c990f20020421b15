"""Line-first quality rules.

Each line of a text is judged by itself: its punctuation (symbols instead of prose, exclamation after every word, STOP_WITHIN
words without any stop), its shape as navigation (separators between single words, mostly addresses, mostly menu words), the share of
boilerplate phrases and of the words of consent notices, shouting in capitals, and being a repeat of an earlier line of
REPEAT_FROM letters or more (a short line, as in verse or lists, may recur). Shares of words are judged from SHARES_FROM words and
of letters from LETTERS_FROM on, as one word has no share.

A line is also judged by the lines around it, blank ones passed over: RUN_LINES or more consecutive lines of at most SHORT words, none
of which has a stop, are navigation if at least half of their words begin with a capital or a digit; and consecutive longer
lines without a stop that have STOP_WITHIN words together are unpunctuated.

Failing lines are taken out, and a document that loses more than half of its word characters with them is rejected. Documents that are too short, or mostly repeat their own three-word windows, are rejected before that.

Defined cases: null or empty text has no words and is rejected; lines end at \\n only; white space is the ASCII set; very
long texts are read whole; ties cannot arise; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, held, table

SPACES, SYMBOLS, STOPS = " \t\n\x0b\x0c\r", "#*$%&|<>", re.compile(r"[.,;:!?…。，！？]")
SEPARATORS = frozenset("| » › > · • / \\ – — :: >> || // ~ → ← « ‹ *".split())
ADDRESS = re.compile(r"(?:https?://|www\.)\S")
#: What notices of consent are about; they hold a word for cookies and others of these.
COOKIE = frozenset("cookie cookies".split())
CONSENT = COOKIE | frozenset(
    "consent preferences settings partners partner tracking track analytics personalise personalize personalised personalized advertising advertisements ads third party parties privacy browser website site"
    " device devices accept reject decline agree agreeing traffic visitors visit necessary functional essential optional store stored storing analyse analyze policy use uses used using"
    " einwilligung zustimmung zustimmen einstellungen webseite akzeptieren ablehnen consentement accepter refuser paramètres aceptar rechazar navegador".split()
)
MENU = frozenset(
    "home menu login logout register search sitemap contact about next previous back top share print help faq rss subscribe imprint account cart checkout wishlist archive"
    " startseite kontakt anmelden abmelden suche hilfe impressum warenkorb inicio contacto buscar ayuda acceder accueil rechercher connexion aide panier".split()
)
#: Boilerplate phrases, each under a word that a line must hold before it is tried; lines are lower-cased and without marks.
PHRASES = {
    "rights": "all rights reserved", "privacy": "privacy (?:policy|notice|settings)", "terms": "terms (?:of (?:use|service|sale)|and conditions)",
    "cookie": "cookie (?:policy|settings|preferences)|manage cookie", "cookies": "(?:uses?|using|accept|reject|about) (?:all |of )?cookies|cookies (?:akzeptieren|annehmen|aceptar)|(?:accepter|aceptar) (?:les |las )?cookies",
    "javascript": "(?:enable|requires?|activate) javascript|javascript (?:is )?(?:disabled|required|aktivieren)", "click": "click (?:here|below|to)", "newsletter": "sign up for (?:our|the) newsletter|newsletter abonnieren",
    "subscribe": "subscribe (?:now|to (?:our|the|this))", "unsubscribe": "unsubscribe", "follow": "follow us(?: on)?", "share": "share (?:this|on) (?:post|page|article|facebook|twitter)?", "top": "back to top",
    "powered": "powered by \\w+", "lorem": "lorem ipsum", "read": "read more", "reading": "continue reading", "skip": "skip to (?:main )?(?:content|navigation)", "leave": "leave a (?:comment|reply)",
    "log": "log in to (?:comment|continue|reply|view)", "related": "related (?:articles|posts|stories|products)", "sponsored": "sponsored (?:content|post|links)", "filed": "filed under", "trademarks": "all (?:other )?trademarks",
    "page": "page \\d+ of \\d+", "download": "download (?:our|the) (?:free )?app", "browser": "your browser (?:does not|is not)|update your browser", "rechte": "alle rechte vorbehalten", "datenschutz": "datenschutz",
    "datenschutzerklärung": "datenschutzerklärung", "weiterlesen": "weiterlesen", "seitenanfang": "zum seitenanfang", "droits": "tous droits réservés", "mentions": "mentions légales", "confidentialité": "politique de confidentialité",
    "suite": "lire la suite", "derechos": "todos los derechos reservados", "aviso": "aviso legal", "privacidad": "política de privacidad", "leer": "leer más", "volver": "volver arriba",
}
BOILERPLATE = {word: re.compile(rf"\b(?:{phrase})\b") for word, phrase in PHRASES.items()}
WORDS_ONLY = str.maketrans(dict.fromkeys(".,:;|!?()[]\"'…&-–—/", " "))
MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 0.5, 0.5
MAX_SYMBOLS, MAX_SHOUTED, MAX_EXCLAIMED, MAX_SEPARATED, MAX_MENU, MAX_BOILERPLATE = 0.1, 0.7, 0.3, 0.2, 0.5, 0.1  # shares of a line
MAX_ADDRESSES, MAX_CONSENT, MAX_TITLED = 0.3, 0.15, 0.5  # shares of a line's or a run's words
SHARES_FROM, LETTERS_FROM, STOP_WITHIN, REPEAT_FROM = 3, 10, 60, 20  # words or letters from which a line is judged by shares of them; words without a stop; letters of a repeat
SHORT, RUN_LINES = 6, 6  # words of a short line, and lines of a run of them


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = covered.count(1)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeated


def line_fault(line: str) -> str | None:
    """The first rule that a line with words breaks. All rules but the last hold for lines of any length."""
    words = line.split()
    n, chars = len(words), sum(map(len, words))
    if sum(map(line.count, SYMBOLS)) > MAX_SYMBOLS * chars:
        return "symbols"
    if n >= SHARES_FROM:
        if not SEPARATORS.isdisjoint(words) and sum(w in SEPARATORS for w in words) > MAX_SEPARATED * n:
            return "navigation"
        if ("://" in line or "www." in line) and sum(ADDRESS.match(w) is not None for w in words) > MAX_ADDRESSES * n:
            return "navigation"
        if line.count("!") > MAX_EXCLAIMED * n:
            return "exclamation"
        letters = sum(map(str.isalpha, line))
        if letters >= LETTERS_FROM and sum(map(str.isupper, line)) > MAX_SHOUTED * letters:
            return "capitals"
    lower = line.lower().translate(WORDS_ONLY).split()
    there = set(lower)
    if not there.isdisjoint(MENU) and sum(w in MENU for w in lower) > MAX_MENU * len(lower):
        return "navigation"
    if n >= SHARES_FROM and not there.isdisjoint(COOKIE) and len(there & CONSENT) > 1 and sum(w in CONSENT for w in lower) >= MAX_CONSENT * len(lower):
        return "boilerplate"
    if not there.isdisjoint(BOILERPLATE):
        plain = " ".join(lower)
        if sum(len(m[0]) for w in there & BOILERPLATE.keys() for m in BOILERPLATE[w].finditer(plain)) >= MAX_BOILERPLATE * len(plain):
            return "boilerplate"
    if n >= STOP_WITHIN and not STOPS.search(line):
        return "unpunctuated"
    return None


def runs_at_fault(lines: list[tuple[int, str]]) -> set[int]:
    """lines: number and text of those that have words. The numbers of those that fail with their neighbours."""
    out: set[int] = set()
    run: list[tuple[int, list[str]]] = []
    is_short = False

    def end() -> None:
        words = [w for _, ws in run for w in ws]
        if is_short:
            at_fault = len(run) >= RUN_LINES and sum(w[0].isupper() or w[0].isdigit() for w in words) >= MAX_TITLED * len(words)
        else:
            at_fault = len(words) >= STOP_WITHIN
        if at_fault:
            out.update(i for i, _ in run)
        run.clear()

    for i, line in lines:
        if STOPS.search(line):
            if run:
                end()
            continue
        words = line.split()
        if run and is_short != (len(words) <= SHORT):
            end()
        is_short = len(words) <= SHORT
        run.append((i, words))
    if run:
        end()
    return out


def cleaned(text: str) -> tuple[str, int, int]:
    """The text without its failing lines, the number of these, and the word characters lost with them."""
    lines = text.split("\n")
    bodies = [(i, body) for i, line in enumerate(lines) if (body := line.strip(SPACES))]
    out = runs_at_fault(bodies)
    seen: set[str] = set()
    for i, body in bodies:
        line = lines[i]
        if (len(body) >= REPEAT_FROM and line in seen) or line_fault(line):
            out.add(i)
        else:
            seen.add(line)
    lost = sum(len(lines[i]) - sum(map(lines[i].count, SPACES)) for i in out)
    return "\n".join([line for i, line in enumerate(lines) if i not in out]) if out else text, len(out), lost


def judged(text: str | None) -> dict:
    """Counts, verdict, and the text without its failing lines, if it has any."""
    text = text or ""
    n, chars, symbols, dup, repeat = base_counts(text)
    base = n < MIN_WORDS or repeat > MAX_REPEATED * n
    clean, failed, lost = cleaned(text)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base,
        "kept": not base and lost <= MAX_LOST * chars, "n_failed_lines": failed, "lost_chars": lost, "clean_text": clean if failed else None,
    }


FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "n_failed_lines": pa.int64(), "lost_chars": pa.int64(), "clean_text": pa.string(),
}
KINDS = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}


def verdicts(fields: list[str], text: str = "text"):
    """A column: a struct of the named fields for each text."""

    @F.arrow_udf(", ".join(f"{f} {KINDS[FIELDS[f]]}" for f in fields))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held(None, lambda: None)
        for texts in batches:
            rows = [judged(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[f] for r in rows], FIELDS[f]) for f in fields], fields)

    return run.asNondeterministic()(text)  # else a filter on it would have it computed twice


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [f for f in FIELDS if f != "clean_text"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", verdicts(fields).alias("v")).select("doc_id", "v.*")


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their failing lines taken out."""
    (v,) = fresh(docs, "_v")
    judged_ = docs.withColumn(v, verdicts(["kept", "n_failed_lines", "clean_text"])).where(F.col(v)["kept"])
    changed, clean = F.col(v)["n_failed_lines"] > 0, F.col(v)["clean_text"]
    out = {"text": F.when(changed, clean).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return judged_.select(*(out.get(c, F.col(c)).alias(c) for c in docs.columns))
