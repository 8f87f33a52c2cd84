"""Chat formatting with typed content parts, a reversible template and a loss mask.

A conversation is a set of rows (conversation, turn, role, content). Content is an
array of typed parts; a plain text is one text part. ``flatten_parts`` visits the
parts in order and turns each into text: text parts are escaped, other parts become
a placeholder and an entry in the attachment list, with the number of tokens that a
model would expand the placeholder to. ``format_conversations`` joins the turns
under the template and records character spans of the loss mask;
``parse_formatted`` reads turns, their parts and masked texts back from the output.

Everything is built from DataFrame functions. Turns are rendered before the
shuffle, so a conversation's aggregate only concatenates finished strings. One
conversation is one output row and has to fit a row; conversations are
independent, so nothing larger than one of them meets in a task.

Defined results: a null text, role or part counts as empty; empty text parts leave
no trace; kinds are compared in lower case, and a part of another kind than text,
image, audio or document is an attachment under the placeholder ``other``, which
keeps its own kind in the list; an empty table gives an empty table; rows that share a turn are ordered by role, then by text, and
repeated rows are all kept; further columns are ignored, whatever their names.
A null conversation id is a conversation of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import bound, running_sums

#: Type of a content part: kind is text, image, audio or document; text parts use
#: ``text``, the others ``ref`` and their extent.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of the template and the control strings that texts must not forge.

    Between adjoining text parts stands ``part``; a placeholder is ``<|kind:ordinal|>``.
    Every mark starts with ``<|`` and every escaped control string is broken after
    its first character by a backslash; backslashes themselves are doubled.
    """

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    part: str = "<|part|>"
    #: Java regular expressions, each split into its first character and the rest.
    controls: tuple[tuple[str, str], ...] = (("<", r"\|"), ("<", r"/?s>"), (r"\[", r"/?INST\]"), ("<", r"</?SYS>>"))
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Pixels of an image patch's side, audio tokens a second, tokens a page.
    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 256

    #: Kinds of parts with a placeholder of their own.
    kinds: tuple[str, ...] = ("image", "audio", "document")

    @property
    def between_regex(self) -> str:
        """What may stand between the text pieces of a turn."""
        return rf"\Q{self.part}\E|<\|(?:{'|'.join((*self.kinds, 'other'))}):[0-9]+\|>"

    @property
    def control_regex(self) -> str:
        return "|".join(f"{first}(?={rest})" for first, rest in self.controls)


def escape(text: Column, template: ChatTemplate) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({template.control_regex})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _kind(part: Column, template: ChatTemplate) -> Column:
    """The placeholder's kind."""
    kind = F.lower(part["kind"])
    return F.when(kind.isin(*template.kinds), kind).otherwise("other")


def expanded_tokens(part: Column, template: ChatTemplate) -> Column:
    """Tokens that a placeholder stands for: patches, seconds or pages, one at least."""

    def sides(x: str) -> Column:
        return F.ceil(F.coalesce(part[x], F.lit(0)) / template.patch)

    many = (
        F.when(F.lower(part["kind"]) == "image", sides("width") * sides("height"))
        .when(F.lower(part["kind"]) == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * template.audio_rate))
        .when(F.lower(part["kind"]) == "document", F.coalesce(part["pages"], F.lit(0)) * template.page_tokens)
        .otherwise(0)
    )
    return F.greatest(many.cast("long"), F.lit(1).cast("long"))


def _is_text(part: Column) -> Column:
    return part.isNull() | part["kind"].isNull() | (F.lower(part["kind"]) == "text")


def flatten_parts(parts: Column, template: ChatTemplate) -> Column:
    """Struct (content, attachments) of an array of ``PART``, parts in their order.

    A placeholder names the part's kind and its ordinal in ``attachments``.
    """

    def visit(seen: Column) -> Column:
        attachments = F.transform(
            F.filter(seen, lambda p: ~_is_text(p)), lambda p, i: F.struct(i.cast("int").alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p, template).alias("tokens"))
        )
        # ordinals are the numbers of attachments ahead
        ahead = running_sums(F.transform(seen, lambda p: F.when(_is_text(p), 0).otherwise(1).cast("long")))
        after_text = F.transform(seen, lambda p, i: _is_text(p) & (i > 0) & _is_text(F.get(seen, i - 1)))
        steps = F.arrays_zip(seen.alias("p"), ahead.alias("n"), after_text.alias("after_text"))

        def shown(x: Column) -> Column:
            p = x["p"]
            placeholder = F.concat(F.lit("<|"), _kind(p, template), F.lit(":"), x["n"].cast("string"), F.lit("|>"))
            said = F.concat(F.when(x["after_text"], template.part).otherwise(""), escape(F.coalesce(p["text"], F.lit("")), template))
            return F.when(_is_text(p), said).otherwise(placeholder)

        return F.struct(F.array_join(F.transform(steps, shown), "").alias("content"), attachments.alias("attachments"))

    return bound(F.filter(parts, lambda p: ~_is_text(p) | (F.coalesce(p["text"], F.lit("")) != "")), visit)


def text_part(text: Column) -> Column:
    """An array of ``PART`` with one text."""
    return F.array(F.from_json(F.lit("{}"), PART[7:-1].replace(":", " ")).withField("kind", F.lit("text")).withField("text", text))


def format_conversations(
    rows: DataFrame,
    template: ChatTemplate | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    parts: str | None = None,
) -> DataFrame:
    """One row a conversation: ``formatted``, ``loss_spans``, ``attachments``.

    ``loss_spans`` holds (place, start, end) of each text under the loss mask: the
    turn's place in the conversation and code points of ``formatted``, end exclusive.
    ``attachments`` carries the turn's place, too.
    """
    template = template or ChatTemplate()
    content = flatten_parts(text_part(F.col(text)) if parts is None else F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), template)
    speaker = F.coalesce(F.col(role), F.lit(""))
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), speaker.alias("role"), content.alias("c"))
    head = F.concat(F.lit(template.turn), escape(F.col("role"), template), F.lit(template.body))
    shown = turns.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.concat(head, F.col("c.content"), F.lit(template.end)).alias("shown"),
            F.length(head).alias("before"),
            F.length("c.content").alias("inside"),
            F.col("c.attachments").alias("attachments"),
        ).alias("t"),
    )
    whole = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def masks(ts: Column) -> Column:
        starts = running_sums(F.transform(ts, lambda t: F.length(t["shown"]).cast("long")))
        spans = F.transform(
            F.arrays_zip(ts.alias("t"), starts.alias("at")),
            lambda x, i: F.struct(x["t"]["role"].alias("role"), i.cast("int").alias("place"), (x["at"] + x["t"]["before"]).alias("start"), (x["at"] + x["t"]["before"] + x["t"]["inside"]).alias("end")),
        )
        return F.transform(F.filter(spans, lambda s: s["role"].isin(*template.loss_roles)), lambda s: F.struct(s["place"], s["start"], s["end"]))

    attached = F.flatten(
        F.transform(
            "ts",
            lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("place"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))),
        )
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("formatted"),
        bound(F.col("ts"), masks).alias("loss_spans"),
        attached.alias("attachments"),
    )


def parse_formatted(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Adds ``turns`` (array of role, text and parts) and ``loss_text``, read from the output.

    ``turns`` comes from the marks in ``formatted`` alone, ``loss_text`` from the
    characters under ``loss_spans``; both are unescaped. A turn's ``parts`` are texts
    (kind text) and placeholders (their kind, and the ordinal of their attachment);
    its ``text`` is that of the texts alone.
    """
    template = template or ChatTemplate()
    quoted = lambda x: "\\Q" + x + "\\E"
    between = template.between_regex
    # the last piece follows the final end mark and is empty
    pieces = F.split("formatted", quoted(template.end), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def words(body: Column) -> Column:
        return F.transform(F.split(body, between, -1), unescape)

    def parts(body: Column) -> Column:
        said = F.transform(words(body), lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("int").alias("ordinal")))
        marks = F.transform(
            F.regexp_extract_all(body, F.lit(between), F.lit(0)),
            lambda m: F.struct(F.regexp_extract(m, "[a-z]+", 0).alias("kind"), F.lit(None).cast("string").alias("text"), F.regexp_extract(m, "[0-9]+", 0).try_cast("int").alias("ordinal")),
        )
        mixed = F.flatten(F.transform(F.arrays_zip(said.alias("a"), marks.alias("b")), lambda x: F.array(x["a"], x["b"])))
        return F.filter(mixed, lambda p: (p["kind"] != "part") & ((p["kind"] != "text") | (p["text"] != "")))

    def turn(p: Column) -> Column:
        body = F.substring_index(p, template.body, -1)
        role = unescape(F.substring_index(F.substr(p, F.lit(len(template.turn) + 1)), template.body, 1))
        return F.struct(role.alias("role"), F.array_join(words(body), "").alias("text"), parts(body).alias("parts"))

    # where each piece starts, so that a span is cut from its own turn and not from the whole string
    starts = running_sums(F.transform("pieces", lambda p: (F.length(p) + len(template.end)).cast("long")))

    def masked(at: Column) -> Column:
        def under(s: Column) -> Column:
            first = (s["start"] - F.get(at, s["place"])).cast("int")
            return F.array_join(words(F.substr(F.get(F.col("pieces"), s["place"]), first + 1, (s["end"] - s["start"]).cast("int"))), "")

        return F.array_join(F.transform("loss_spans", under), "")

    cut = formatted.withColumn("pieces", pieces).withColumn("turns", F.transform("pieces", turn))
    return cut.withColumn("loss_text", bound(starts, masked)).drop("pieces")
