"""Reviews folded message by message: each one changes what the next one means.

Within a session messages stand in order.  A list of questions stays open until an
answer to it is understood; until then every message is taken for one.  After that
a message's intent and the parts that it names decide: parts are excluded or sorted
anew, new ones are added below an assembly and can be named by the messages that
follow, what is still open is settled, a part is marked for another look.

What a text says is read by Columns beforehand.  The fold itself keeps one session's
parts at a time and streams over sorted rows, so a session may have any number of
messages; it is one task's, as its messages depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import part_no_strict, squeeze
from partloom.operators.classify import user_intent
from partloom.operators.feedback import DROP, DROP_ALL, KEEP, KEEP_ALL, added_part, has_any

#: Words of a name that name nothing, and a number that is still to come.
STOP_WORDS = ["ASS", "ASSY", "THE", "FOR"]
NO_NUMBER = "(채번 필요)"

_OPEN = {"CHECK", "PENDING", ""}
_PARTS = ["pid", "number", "name", "assembly", "action", "sourcing", "sourcing_reason", "display_no", "recheck"]
_OUT = "session long, kind string, ord long, handled_as string, n_changed int, pid long, number string, name string, assembly string, action string, sourcing string, sourcing_reason string, display_no string, recheck boolean"


def bare_text(c: Column) -> Column:
    """Upper case, letters, digits and Hangul alone."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[^A-Z0-9가-힣]", "")


def name_words(c: Column) -> Column:
    """The words of a name that can stand for it."""
    return F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), r"[\s,/\-\(\)]+"), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))


def read_messages(messages: DataFrame) -> DataFrame:
    """session, ord, said: what each message (session, ord, text, asks) says."""
    text = squeeze(F.coalesce(F.col("text"), F.lit("")))
    low = F.lower(text)
    number = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.try_cast("int"))
    swaps = F.regexp_extract_all(text, F.lit(r"(?i)(\d+번.*?[A-Z]{2,3}\d{8,12}.*?(?:바꿔|교체|대체|변경))"), 1)
    swap = lambda x: F.struct(F.regexp_extract(x, r"(\d+)번", 1).try_cast("int").alias("num"), F.upper(F.regexp_extract(x, r"(?i)번.*?([A-Z]{2,3}\d{8,12})", 1)).alias("number"))
    said = F.struct(
        F.coalesce("asks", F.array().cast("array<long>")).alias("asks"), number(r"(\d+)\s*번").alias("numbered"), number(r"(\d+)").alias("numbers"),
        has_any(low, DROP_ALL).alias("drop_all"), has_any(low, KEEP_ALL).alias("keep_all"), F.contains(low, F.lit("만 유지")).alias("only"), has_any(low, DROP).alias("drop"), has_any(low, KEEP).alias("keep"),
        F.transform(swaps, swap).alias("swaps"), user_intent(F.col("text")).alias("intent"), added_part(text).alias("added"),
        F.when(F.contains(low, F.lit("공용")), "공용검토").when(has_any(low, ["신규", "채번"]), "신규").otherwise("").alias("sourcing"),
        F.when(has_any(low, ["변경", "시방"]), "MODIFY").when(F.contains(low, F.lit("삭제")), "REMOVE").otherwise("ADD").alias("bulk"),
        F.upper(F.coalesce("text", F.lit(""))).alias("upper"), bare_text(F.col("text")).alias("bare"),
    )
    return messages.select(F.col("session").cast("long").alias("session"), F.col("ord").cast("long").alias("ord"), said.alias("said"))


class Session:
    """The parts of one session, its open questions, and what messages do to them."""

    def __init__(self) -> None:
        self.parts: dict[int, dict] = {}
        self.asked: list[int] = []

    def named(self, said: dict) -> tuple[list[dict], list[str]]:
        """Parts that a message names, by number or else by a word of their name, and assemblies."""
        found = []
        for p in self.parts.values():
            by_number = len(p["bare"]) >= 5 and p["bare"] in said["bare"]
            if by_number or any(w in said["upper"] for w in p["words"]):
                found.append(p)
        above = dict.fromkeys(a for p in self.parts.values() for a in p["above"] if a in said["upper"])
        return found, list(above)

    def answer(self, said: dict) -> int | None:
        """Settle the open questions; None if the message doesn't say how."""
        n = len(self.asked)
        nums = [x for x in said["numbered"] if x is not None and 1 <= x <= n] or [x for x in said["numbers"] if x is not None and 1 <= x <= n]
        if said["drop_all"]:
            out = set(range(1, n + 1))
        elif said["keep_all"]:
            out = set()
        elif nums and said["only"]:
            out = set(range(1, n + 1)) - set(nums)
        elif nums and said["drop"]:
            out = set(nums)
        elif nums and said["keep"]:
            out = set(range(1, n + 1)) - set(nums)
        else:
            return None
        swaps = {s["num"]: s["number"] for s in said["swaps"] if s["num"] is not None and 1 <= s["num"] <= n}
        for num in sorted(out | set(swaps)):
            part = self.parts.get(self.asked[num - 1])
            if part is not None:
                part["action"] = "EXCLUDE"
                if num in swaps:
                    self.add(part["name"], part["assembly"], swaps[num])
        self.asked = []
        return len(out | set(swaps))

    def add(self, name: str, assembly: str, number: str = "") -> None:
        pid = max(self.parts, default=0) + 1
        words = [w for w in pd.Series([name]).str.upper().str.split(r"[\s,/\-\(\)]+", regex=True)[0] if len(w) >= 2 and w not in STOP_WORDS]
        self.parts[pid] = {
            "pid": pid, "number": number, "name": name, "assembly": assembly, "action": "ADD", "sourcing": "" if number else "신규", "sourcing_reason": "",
            "display_no": number or NO_NUMBER, "recheck": False, "bare": number, "words": words, "above": self.above_of(assembly),
        }

    def above_of(self, assembly: str) -> list[str]:
        return next((p["above"] for p in self.parts.values() if p["assembly"] == assembly), [])

    def handle(self, said: dict) -> tuple[str, int]:
        """How a message is taken, and how many parts it changes."""
        if said["asks"]:
            self.asked = list(said["asks"])
            return "ASK", 0
        if self.asked:
            n = self.answer(said)
            return ("UNCLEAR", 0) if n is None else ("ANSWER", n)
        intent = said["intent"]
        targets, above = self.named(said)
        if intent == "EXCLUDE":
            for p in targets:
                p["action"] = "EXCLUDE"
        elif intent == "SOURCING":
            for p in targets if said["sourcing"] else []:
                self.sort_anew(p, said["sourcing"])
            targets = targets if said["sourcing"] else []
        elif intent == "BULK":
            targets = [p for p in self.parts.values() if p["action"].upper() in _OPEN]
            for p in targets:
                p["action"] = said["bulk"]
        elif intent == "ADD":
            targets = [said] if said["added"]["name"] else []
            for _ in targets:
                first = next(iter(self.parts.values()), {"assembly": ""})["assembly"]
                hint = next((p["assembly"] for p in self.parts.values() if set(p["above"]) & set(above)), first)
                self.add(said["added"]["name"], hint if said["added"]["parent"] else first)
        elif intent == "RECHECK":
            targets = targets[:1]
            for p in targets:
                p["recheck"] = True
        else:
            targets = []
        return intent, len(targets)

    @staticmethod
    def sort_anew(p: dict, sourcing: str) -> None:
        known = p["number"] not in ("", NO_NUMBER)
        p["sourcing"] = sourcing
        if sourcing == "신규":
            if known:
                p["sourcing_reason"] = "참고: " + p["number"]
            p["display_no"] = NO_NUMBER
        else:
            p["sourcing_reason"] = ""
            if known:
                p["display_no"] = p["number"]


def fold_sessions(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """kind 'log': session, ord, handled_as, n_changed of every message; kind 'part': every
    part of a session after its last message.

    parts: session, pid, number, name, assembly, action, sourcing, display_no;
    messages: session, ord, text, asks (numbers of parts that a message asks about,
    null or empty for none).  Sessions without parts have nothing to change: their messages
    are logged.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    part = F.struct(
        F.col("pid").cast("long").alias("pid"), *(blank(c) for c in ("number", "name", "assembly", "action", "sourcing", "display_no")),
        part_no_strict(F.col("number")).alias("bare"), name_words(F.col("name")).alias("words"), name_words(F.col("assembly")).alias("above"),
    )
    own = parts.select(F.col("session").cast("long").alias("session"), F.lit(0).alias("phase"), F.col("pid").cast("long").alias("ord"), part.alias("part"))
    rows = own.unionByName(read_messages(messages).withColumn("phase", F.lit(1)), allowMissingColumns=True)
    ordered = rows.repartition("session").sortWithinPartitions("session", "phase", "ord").select("session", "phase", "ord", "part", "said")
    names = [c.split(" ")[0] for c in _OUT.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, out = None, Session(), []

        def ended() -> list[tuple]:
            return [(at, "part", None, None, None, *(p[c] for c in _PARTS)) for p in state.parts.values()]

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.session != at:
                    out += ended() if at is not None else []
                    at, state = r.session, Session()
                if r.phase == 0:
                    p = dict(r.part)
                    state.parts[p["pid"]] = p | {"sourcing_reason": "", "recheck": False, "words": list(p["words"]), "above": list(p["above"])}
                else:
                    handled, n = state.handle({k: (list(v) if hasattr(v, "tolist") else v) for k, v in dict(r.said).items()})
                    out.append((at, "log", r.ord, handled, n, *[None] * len(_PARTS)))
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if at is not None and (last := ended()):
            yield pd.DataFrame(last, columns=names, dtype=object)

    return ordered.mapInPandas(fold, _OUT)
