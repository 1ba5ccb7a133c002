"""Personal data by weak supervision.

Candidate spans come from patterns: the four base kinds, and names, identity numbers and account numbers. Three
labelers vote on each (pattern shape, gazetteer, context to the left); expectation maximisation over the counts of
vote patterns, taken over all candidates of the corpus, estimates how reliable each labeler is for each kind; the
posteriors train a logistic span classifier on vote and shape features. Base spans always stay; spans of the other
kinds are added where the classifier says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import table, texts, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "person", "identity", "account")
LABELERS = 3
#: Cells of the candidates' features: kind x three votes of three values x shapes (four lengths, and whether the span
#: holds a separator, stands in brackets or quotes or behind a colon, and ends a sentence or line).
SHAPES = 32
CELLS = len(KINDS) * 3**LABELERS * SHAPES
CONTEXT = 28
CLAUSE = re.compile(r"[,;!?\n]|\. ")
PROBABILITY = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of everything that addresses, cards and phone numbers are made of; none of their matches leaves it.
CLUSTER = re.compile(r"\+?[0-9][\x20().0-9-]*")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: A name: a capital and small letters of the western European languages, once more behind a hyphen or apostrophe.
NAME = r"[A-Z\u00C0-\u00D6\u00D8-\u00DE](?:['\u2019][A-Z])?[a-z\u00DF-\u00F6\u00F8-\u00FF]+(?:-[A-Z\u00C0-\u00D6\u00D8-\u00DE][a-z\u00DF-\u00F6\u00F8-\u00FF]+)?"
PERSON = re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?|Herr|Frau|Madame|Monsieur|Mme|Señora?|Don|Doña)\x20{NAME}(?:\x20{NAME})?(?!\w)|(?<!\w){NAME}\x20{NAME}(?!\w)")
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Madame Monsieur Mme Señor Señora Don Doña".split())

# gazetteers
TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es uk eu it nl ch at us ca au jp example test".split())
GIVEN_NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Andrew Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Amanda Alice Emma Olivia Bob Jack Harry Oliver Peter Hans Klaus Jürgen Wolfgang Stefan Andreas Uwe Günter Dieter Matthias Jens Ursula Sabine Monika Petra "
    "Renate Heike Ingrid Anna Katrin Birgit Lukas Leon Pierre Jean Jacques Michel Philippe Alain Nicolas Luc François Étienne René Hélène Marie Claire Sophie Nathalie Isabelle Sylvie Chloé Camille Élodie Zoé Juan "
    "Carlos Luis José Antonio Manuel Francisco Javier Miguel Pedro Jesús Ángel Sergio Pablo Jorge Álvaro Andrés Raúl Iván María Carmen Ana Isabel Dolores Pilar Teresa Lucía Marta Cristina Laura Elena Raquel Inés Paul "
    "Maria Eva Julia Martin Simon Max Felix Sofia Clara Nina".split()
)
DIALLING = ("+1", "+33", "+34", "+44", "+49", "+39", "+31", "+41", "+43", "+61", "+81", "+86", "+91", "+55", "+52")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
ACCOUNT_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CUES = {
    "email": "mail email mails contact contacts write reply kontakt contacto courriel correo",
    "ip": "ip host hosts server address from login client adresse dirección",
    "card": "card cards visa mastercard amex credit karte kreditkarte carte tarjeta pay paid",
    "phone": "phone telephone tel call mobile fax cell anruf telefon appel appelez téléphone llame llamar teléfono móvil",
    "person": "mr mrs ms dr prof name names dear herr frau author by signed nom nombre sincerely regards",
    "identity": "ssn social security identity id",
    "account": "iban account konto kontonummer compte cuenta bank banque banco",
}
AGAINST = {"email": "", "ip": "version versions release chapter section", "card": "order isbn invoice tracking", "phone": "offset score", "person": "license university street version", "identity": "part serial", "account": "model part"}


def words_in(words: str) -> re.Pattern:
    """Any of the words, whole; nothing where there is none."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(words.split())})(?!\w)" if words else r"(?!)")


CUES, AGAINST = ({k: words_in(v) for k, v in table_.items()} for table_ in (CUES, AGAINST))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    found: list[list[tuple[int, int, int]]] = [[], [], [], []]
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found[0].append((0, start, m.end()))
            floor = m.end()
        floor = max(floor, at + 1)
        at = text.find("@", floor)
    for cluster in CLUSTER.finditer(text):
        base, run = cluster.start(), cluster[0]
        if len(run) < 7:
            continue
        if run.count(".") > 2:
            for m in IP.finditer(run):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                    found[1].append((1, base + m.start(), base + m.end()))
        if len(run) > 9:
            for m in CARD.finditer(run) if len(run) > 12 else ():
                if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                    found[2].append((2, base + m.start(), base + m.end()))
            if run[0] == "+" and (m := PHONE.match(run)) and 9 <= len(digits_of(m[0])) <= 15:
                found[3].append((3, base, base + m.end()))
    return found[0] + found[1] + found[2] + found[3]


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def other_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the added kinds that touch no base span."""
    found = [(4, m.start(), m.end()) for m in PERSON.finditer(text)]
    if "-" in text:
        found += [(5, m.start(), m.end()) for m in IDENTITY.finditer(text)]
    found += [(6, m.start(), m.end()) for m in ACCOUNT.finditer(text)]
    if taken and found:
        first = np.asarray(sorted(s for _, s, _ in taken))
        last = np.maximum.accumulate(np.asarray([e for _, _, e in sorted(taken, key=lambda t: t[1])]))
        found = [f for f in found if not (k := int(np.searchsorted(first, f[2]))) or last[k - 1] <= f[1]]
    return found


def votes(text: str, kind: int, start: int, end: int) -> tuple[tuple[int, int, int], int]:
    """Votes of the pattern, gazetteer and context labelers (0 against, 1 abstains, 2 for) and a shape of 0 to 31."""
    name, span = KINDS[kind], text[start:end]
    left = CLAUSE.split(text[max(0, start - CONTEXT) : start].lower())[-1]  # a cue of another clause tells nothing
    shape = listed = 1
    if name == "email":
        local, _, domain = span.partition("@")
        shape = 2 if local[0] not in ".-%+" and ".." not in span and domain[0] != "-" else 0
        listed = 2 if domain.rpartition(".")[2].lower() in TOP_DOMAINS else 1
    elif name == "ip":
        parts = span.split(".")
        shape = 2 if all(p == str(int(p)) for p in parts) and parts[0] != "0" else 0
        listed = 2 if span.startswith(("10.", "192.168.", "172.16.", "127.")) else 1
    elif name == "card":
        digits = digits_of(span)
        shape = 2 if len(digits) in (15, 16) else 1
        listed = 2 if digits.startswith(CARD_STARTS) else 0
    elif name == "phone":
        shape = 2 if re.fullmatch(r"\+[0-9]{1,3}[ .-]?(\([0-9]+\)[ .-]?)?[0-9]+([ .-][0-9]+)*", span) else 1
        listed = 2 if span.startswith(DIALLING) else 1
    elif name == "person":
        words = span.replace(".", "").split(" ")
        shape = 2 if words[0] in TITLES else 0
        listed = 2 if any(w in GIVEN_NAMES or w.partition("-")[0] in GIVEN_NAMES for w in words) else 1 if shape else 0
    elif name == "identity":
        shape = 0 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 2
    else:
        plain = span.replace(" ", "")
        shape = 2 if mod97(plain) else 0
        listed = 2 if plain[:2] in ACCOUNT_COUNTRIES else 0
    context = 2 if CUES[name].search(left) else 0 if AGAINST[name].search(left) else 1
    before, after = left.rstrip(" ")[-1:], text[end : end + 2]
    marks = (any(c in " ()-" for c in span), before in ("(", "[", "<", '"', ":", "="), not after or after[0] == "\n" or (after[0] in ".!?" and after[1:] in ("", " ", "\n")))
    return (shape, listed, context), 8 * min(3, len(span) // 8) + sum(m << i for i, m in enumerate(marks))


def cell(kind: int, vote: tuple[int, int, int], shape: int) -> int:
    return ((kind * 27) + vote[0] * 9 + vote[1] * 3 + vote[2]) * SHAPES + shape


def cell_parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (cells x labelers) and shape of every cell."""
    c = np.arange(CELLS)
    v = c // SHAPES % 27
    return c // SHAPES // 27, np.stack([v // 9, v // 3 % 3, v % 3], 1), c % SHAPES


def estimate(counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each cell and the labelers' reliabilities (kind, class, labeler, vote), by expectation maximisation."""
    kind, vote, _ = cell_parts()
    score = (vote - 1).sum(1)
    q = np.clip(0.5 + 0.2 * score, 0.05, 0.95)
    k, pick = len(KINDS), np.eye(3)
    rel = np.zeros((k, 2, LABELERS, 3))
    for _ in range(rounds):
        prior = np.zeros(k)
        for j in range(k):
            own = kind == j
            for z, w in ((1, q[own] * counts[own]), (0, (1 - q[own]) * counts[own])):
                # each labeler is taken to be better than chance: two imagined votes that agree with the class
                imagined = np.asarray([0.5, 1.0, 2.0] if z else [2.0, 1.0, 0.5])
                votes_of = np.stack([(w[:, None] * pick[vote[own, i]]).sum(0) + imagined for i in range(LABELERS)])
                rel[j, z] = votes_of / votes_of.sum(1, keepdims=True)
            prior[j] = ((q[own] * counts[own]).sum() + 1) / (counts[own].sum() + 2)
        logit = np.log(prior / (1 - prior))[kind]
        for i in range(LABELERS):
            logit = logit + np.log(rel[kind, 1, i, vote[:, i]] / rel[kind, 0, i, vote[:, i]])
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, rel


def classify(counts: np.ndarray, posterior: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Probability of every cell under a logistic model trained on the posteriors, each cell weighted by its count."""
    kind, vote, shape = cell_parts()
    # the votes count for each kind anew, the span's own form (length and three marks) for all kinds alike
    by_kind = np.eye(3 * len(KINDS))
    x = np.concatenate([np.eye(len(KINDS))[kind], *[by_kind[3 * kind + vote[:, i]] for i in range(LABELERS)], np.eye(4)[shape // 8], *[(shape >> i & 1)[:, None] for i in range(3)]], 1)
    weight = np.sqrt(counts) + 0.01
    weight = weight / weight.sum()
    beta, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        velocity = 0.9 * velocity - 1.0 * (x.T @ (weight * (p - posterior)) + 1e-4 * beta)
        beta = beta + velocity
    return 1 / (1 + np.exp(-x @ beta))


SPANS = "array<struct<kind:int,start:int,end:int,cell:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    kinds = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "cell")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                found += other_spans(text, found)
                out.append([{"kind": k, "start": s, "end": e, "cell": cell(k, *votes(text, k, s, e))} for k, s, e in found])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kinds)], names=["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id long, spans {SPANS}")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", probability: float = PROBABILITY) -> DataFrame:
    """One row per document: doc_id, spans; array of (kind, start, end, cell, p) by kind, then start, in code points.

    Null and empty texts have no spans; texts are read whole; repeated rows get a row each; an empty table gives an
    empty result; other columns are not read. Spans of base kinds are all there, whatever their p.
    """
    found = written(candidates(texts(docs, id_col, text_col)), "pii")
    counts = np.zeros(CELLS)
    for r in found.select(F.explode("spans.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most CELLS rows
        counts[r["cell"]] = r["n"]
    p = classify(counts, estimate(counts)[0])
    model = F.split(F.lit(",".join(f"{v:.6f}" for v in p)), ",").cast("array<double>")
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["cell"].alias("cell"), F.get(model, s["cell"]).alias("p")))
    kept = F.filter(scored, lambda s: (s["kind"] < len(BASE)) | (s["p"] >= probability))
    return found.select("doc_id", F.array_sort(kept).alias("spans"))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    number = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
