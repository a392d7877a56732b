"""Texts put together from tables: assistant prompts, chat windows, order confirmations, replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark import constants
from retail_spark.functions import semantics as sem
from retail_spark.functions.scale import number_rows
from retail_spark.operators.orders import nest_items, order_items

# Fixed text: the assistant's instruction. The slots are filled in order.
ASSISTANT_INSTRUCTION = (
    "Eres {store} IA, un asistente experto de la ferretería {store}. Responde amistosamente y basa tus respuestas "
    "ESTRICTAMENTE en la información proporcionada. Si mencionas un producto, formatea un enlace Markdown: "
    "[Nombre del Producto](/products/ID_DEL_PRODUCTO).\n---\nPolíticas:\n{policies}\n---\nFAQ:\n{faqs}\n---\n"
    "Contexto de Productos:\n{products}\n---\nPregunta del cliente:"
)

# Fixed text: the order confirmation.
CONFIRMATION = (
    "¡Hola, {name}! 👋 Tu pedido #{order} en {store} ha sido recibido con éxito.\n\nResumen de tu compra:\n{items}"
    "\n\nTotal: ${total}\n\n¡Gracias por tu compra! Prepararemos tu pedido para el envío lo antes posible."
)

# Fixed text: the mail a reply is wrapped in.
REPLY_HTML = (
    "<p>Hola,</p><p>Gracias por contactar a {store}. Aquí tienes la respuesta a tu consulta:</p>"
    "<blockquote style='border-left:2px solid #ccc;padding-left:1em;margin-left:1em;color:#555;'>{body}</blockquote>"
    "<p>Saludos,<br>El equipo de {store}</p>"
)

SECTIONS = ["policies", "faqs", "products"]


def fill(template: str, **slots: str | Column) -> Column:
    """A column holding ``template`` with its ``{slots}`` replaced; a null value makes the result null."""
    parts: list[Column] = []
    rest = template
    while rest:
        text, brace, rest = rest.partition("{")
        if text:
            parts.append(F.lit(text))
        if brace:
            name, _, rest = rest.partition("}")
            value = slots[name]
            parts.append(F.lit(value) if isinstance(value, str) else value)
    return F.concat(*parts)


def shown(column: str) -> Column:
    """Text as templates print it: null reads ``null``."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def context_lines(policies: DataFrame, faqs: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """What the assistant knows, one row per policy, question and product: (section, item_id, line).

    Sorted by section and id, the lines joined by line feeds are the context. They stay
    spread over the cluster, whatever their number.
    """
    first = products.orderBy("product_id").limit(n)

    def section(number: int, df: DataFrame, item_id: str, line: Column) -> DataFrame:
        return df.select(
            F.lit(number).alias("section_no"), F.lit(SECTIONS[number]).alias("section"),
            F.col(item_id).alias("item_id"), line.alias("line"),
        )

    return (
        section(0, policies, "policy_id", fill("- {t}: {b}", t=shown("title"), b=shown("body")))
        .unionByName(section(1, faqs, "faq_id", fill("- P: {q}\n  R: {a}", q=shown("question"), a=shown("answer"))))
        .unionByName(
            section(
                2, first, "product_id",
                fill("- ID:{i}, Nombre:{n}, Precio:{p}, Stock:{s}",
                     i=shown("product_id"), n=shown("name"), p=shown("unit_price"), s=shown("stock")),
            )
        )
    )


def assistant_context(
    policies: DataFrame,
    faqs: DataFrame,
    products: DataFrame,
    n: int = 10,
    store_name: str = constants.STORE_NAME,
    context_id: int = 1,
) -> DataFrame:
    """The whole instruction as a numbered table of lines: (context_id, line_no, line).

    In order of number and joined by line feeds, the lines are the instruction. They stay spread over the
    cluster, so there is no limit to what the assistant is told; joining them is left to delivery.
    A section without content has one empty line.
    """
    fixed = [part.strip("\n") for part in re.split(r"\{(?:policies|faqs|products)\}", ASSISTANT_INSTRUCTION)]
    lines = context_lines(policies, faqs, products, n).select("section_no", "item_id", "line")
    spark = lines.sparkSession
    places = [(no, text.replace("{store}", store_name)) for no, text in enumerate(fixed)]
    headings = spark.createDataFrame(places, "section_no INT, line STRING").select(
        "section_no", F.lit(0).alias("_after"), F.lit(None).cast("bigint").alias("item_id"), "line"
    )
    sections = spark.range(len(SECTIONS)).select(F.col("id").cast("int").alias("section_no"))
    filled = lines.groupBy("section_no").agg(F.count(F.lit(1)).alias("_n")).select("section_no")
    blanks = sections.join(filled, "section_no", "left_anti").select(
        "section_no", F.lit(1).alias("_after"), F.lit(None).cast("bigint").alias("item_id"), F.lit("").alias("line")
    )
    content = lines.select("section_no", F.lit(1).alias("_after"), "item_id", "line")
    numbered = number_rows(
        headings.unionByName(blanks).unionByName(content), ["section_no", "_after", "item_id"], "line_no", "context"
    )
    return numbered.select(F.lit(context_id).cast("bigint").alias("context_id"), "line_no", "line")


def assistant_prompts(messages: DataFrame, column: str = "message", context_id: int = 1) -> DataFrame:
    """What to ask for each message that is not empty: the context by its id, and the message to put on the line after it."""
    return messages.filter(sem.has_text(column)).withColumn("context_id", F.lit(context_id).cast("bigint"))


def chat_history_window(conversations: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of every conversation.

    The rank filter lets Spark cut each conversation to ``n`` turns in every map task,
    so even one that holds most of the rows sends only a few to its window.
    """
    newest_first = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        conversations.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= n).drop("_rank")
    )


def order_confirmation_text(
    orders: DataFrame, lines: DataFrame, products: DataFrame, store_name: str = constants.STORE_NAME
) -> DataFrame:
    """The message a buyer gets, in parts, and the number it goes to.

    Part 0 greets, the next ones list a page of items each, the last one has the
    total. In order and joined as they are, the parts are the message; no order is too long for it.
    """
    items = nest_items(
        orders.select("order_id", "total", "ship_name", "ship_phone"),
        order_items(lines, products).select("order_id", "product_id", "quantity", "unit_price", "product_name"),
        "order_id",
        ["product_id", "quantity", "unit_price", "product_name"],
    )
    line = lambda item: fill(
        "- {q}x {n} (${p})",
        q=item["quantity"].cast("string"),
        n=F.coalesce(item["product_name"], F.lit("undefined")),
        p=sem.es_number(item["unit_price"]),
    )
    head, _, foot = CONFIRMATION.partition("{items}")
    first = F.col("page") == 0
    pages = items.select(
        "order_id",
        (F.col("page") + 1).alias("part"),
        sem.normalize_phone("ship_phone").alias("recipient"),
        F.concat(F.when(first, F.lit("")).otherwise(F.lit("\n")), F.array_join(F.transform("items", line), "\n")).alias("body"),
    )
    ends = items.groupBy("order_id").agg(
        (F.max("page") + 2).alias("last"), *[F.first(c).alias(c) for c in ("total", "ship_name", "ship_phone")]
    )
    slots = {"name": shown("ship_name"), "order": F.col("order_id").cast("string"), "store": store_name}
    parts = F.array(
        F.struct(F.lit(0).alias("part"), fill(head, **slots).alias("body")),
        F.struct(F.col("last").alias("part"), fill(foot, total=sem.es_number("total"), **slots).alias("body")),
    )
    around = ends.select(
        "order_id", sem.normalize_phone("ship_phone").alias("recipient"), F.explode(parts).alias("_p")
    ).select("order_id", "_p.part", "recipient", "_p.body")
    return around.unionByName(pages)


def reply_message_body(replies: DataFrame, store_name: str = constants.STORE_NAME) -> tuple[DataFrame, DataFrame]:
    """Replies as mails, and those without recipient, subject or body."""
    complete = sem.has_text("recipient") & sem.has_text("subject") & sem.has_text("body")
    mails = replies.filter(complete).withColumns(
        {
            "mail_subject": F.concat(F.lit("Re: "), F.col("subject")),
            "html": fill(REPLY_HTML, store=store_name, body=F.col("body")),
        }
    )
    return mails, replies.filter(~complete).withColumn("reason", F.lit("missing_field"))
