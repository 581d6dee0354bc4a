"""Text functions as column expressions.

Patterns are written for Java's engine with flags ``(?iuUd)``: Unicode letters and case, and a dot that excludes the line feed only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Animal stems, and one pattern list for each category of unwanted messages, in the order in which they are tried.
PETS = r"котен|котят|котик|кошк|кошеч|кот[аеуио]?\b|щен|собак|пес\b|песик|питом"
SPAM: list[tuple[str, list[str]]] = [
    ("money", [
        r"легк\w*\s+деньг", r"пасс\w*\s+доход", r"доход\w*\s+от\s*\d",
        r"(доход|заработ|зарплат|подработ|получай\w*|платим|выплачива\w*|profit)\w*.{0,30}\d[\d\s]*\s*(\$|€|долл|евро|usd|gel|лари|руб)?\w*\s*в\s+(день|неделю|час|сутки)",
        r"подзаработ", r"(л\.?с\.?|личк\w+)\W{0,40}(доход|заработ|\$|вакан\w*\W{0,10}доход)",
        r"(доход|заработ|\$)\W{0,40}(пиш\w+|жду)\W{0,15}(в\s*)?(л\.?с\.?|личк)", r"набираю\s+(команду|людей|сотрудник)",
        r"(удаленн\w*|онлайн)\s+работ\w*.{0,25}(\d|\$|доход|от\s*\d)", r"крипт\w*\W{0,20}(доход|заработ|профит|x\d)",
    ]),
    ("drugs", [
        r"\bзакладк|кладмен|\bклад\b", r"мефедрон|\bмеф\b|альфа.?пвп|\bа.?пвп\b", r"амфетамин|\bамф\b|метамфетамин",
        r"гашиш|\bгаш\b|шишк|\bбошк|марихуан|\bтрав[аку]\b|гидропон", r"кокаин|\bкок\b|мдма|\bмд\b|экстази|\bлсд\b|\bскорост[ьи]\b",
        r"(проверенн\w*|надежн\w*|лучш\w*)\s+магазин.{0,15}(24|круглосут|тгк|шоп)", r"автопрода\w|автошоп|наркошоп|\bтгк\b",
        r"24/7\W{0,20}(магазин|шоп|достав|клад)",
    ]),
    ("ads", [
        r"(канал|ссылк\w+|подробност\w+|инфо)\W{0,20}(в\s+)?(описани|профил|шапк|био|bio)",
        r"в\s+описани\w*\W{0,15}(к\s+)?(мо\w+|наш\w+|аккаунт|профил)",
        r"(подпис\w+|переход\w+|залетай\w*|вступай\w*|жми)\W{0,20}(на\s+|в\s+|по\s+)?(канал|ссылк|профил|блог)",
        r"приглаша\w+\W{0,15}(в\s+)?(мо\w+|наш\w+)\s+(канал|чат|блог|сообществ)",
        r"(бесплатн\w+)\s+(вебинар|гайд|чек.?лист|марафон|консультац|мастер.?класс)",
        r"(марафон|интенсив|курс)\W{0,20}(похуд|стройн|здоров|гармони|запис|стартуе)", r"пут[ьи]\s+к\s+(гармони|стройн|себе|здоров|успех|богатств)",
    ]),
    ("pets", [
        r"в\s+добр\w+\s+рук", r"(отда[ме]\w*|пристраива\w*|забер\w+|возьмите).{0,30}({PETS}|животн)",
        r"({PETS}|хвостик).{0,30}(ищ[еую]\w*|в\s+поиск\w*).{0,25}(дом|семь|хозя|рук)", r"ищ[еую]\w*.{0,25}(дом|семь|хозя\w+|рук).{0,25}({PETS})",
        r"пристраива\w*.{0,20}(животн|{PETS})", r"возьмите.{0,20}(домой|в\s+семь)",
    ]),
]
ASKING = r"подскаж|посовет|порекоменд|кто[\s-]*(знает|в\s+курсе|сталкив\w*|нибудь)|есть\s+ли|где\s+(можно|найти|это|их|они|проход|взять|у\s+вас)|как\s+(можно|мне|это|тут|у\s+вас)"
PETS_ADVICE = r"\bгайд|\bприют|\bчат\b|\bчаты|где\s+можно|куда\s+(можно\s+)?пристро|как\s+пристро|инстаграм"
NON_ANSWER = [
    r"информаци\w*.{0,120}?(не\s+(указан|предоставлен|найден|дан|сообщ)\w*|отсутствует|\bнет\b)", r"не\s+(указан|предоставлен|найден|сообщ)\w*\s+(конкретн\w*\s+)?информаци",
    r"нет\s+(точной|конкретной|)\s*информаци", r"данн\w*\s+(отсутств\w*|не\s+(указан|предоставлен)\w*)", r"\bнеизвестн\w*",
]
MONTHS = ["январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]
NO_CITY = ["", "null", "none", "-"]
ANONYMOUS = "Аноним"

FLAGS = "(?iuUd)"


def _find(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    return text.rlike(flags + pattern)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def spam_reason(text: Column, categories: list[tuple[str, list[str]]] | None = None, asking: str | None = ASKING, exempt: dict[str, str] | None = None) -> Column:
    """First category with a match, else null; null for questions, and for an exempt text of a category.

    One ``CASE``: each category is one alternation, since its patterns stand together.
    """
    exempt = {"pets": PETS_ADVICE} if exempt is None else exempt
    folded = F.translate(text, "ёЁ", "еЕ")
    out = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    if asking:
        out = out.when(_find(folded, asking), None)
    for name, patterns in SPAM if categories is None else categories:
        hit = _find(folded, "|".join(f"(?:{p.replace('{PETS}', PETS)})" for p in patterns))
        out = out.when(hit, F.when(_find(folded, exempt[name]), None).otherwise(F.lit(name)) if name in exempt else F.lit(name))
    return out


def is_non_answer(text: Column, patterns: list[str] | None = None) -> Column:
    return _find(text, "|".join(f"(?:{p})" for p in patterns or NON_ANSWER))


def city_or_null(city: Column) -> Column:
    """Stripped city; words that stand for none give null."""
    clean = strip(city)
    return F.when(~F.lower(clean).isin(NO_CITY), clean)


def gap_label(minutes: Column) -> Column:
    return (
        F.when(minutes < 60, F.format_string("%d мин", minutes.cast("int")))
        .when(minutes < 1440, F.format_string("%.1f ч", minutes / 60))
        .otherwise(F.format_string("%.1f дн", minutes / 1440))
    )


def month_label(iso: Column, months: list[str] | None = None) -> Column:
    """Month and year of ISO text; empty if there is none."""
    ts = F.try_to_timestamp(iso)
    name = F.element_at(F.array(*map(F.lit, months or MONTHS)), F.month(ts))
    return F.when(ts.isNull(), "").otherwise(F.concat(name, F.lit(" "), F.year(ts).cast("string")))


def chat_link(private: Column, chat_id: Column, username: Column, msg_id: Column) -> Column:
    """Public chats by name; private ones by the id without its first three digits."""
    inner = F.substring(F.abs(chat_id).cast("string"), 4, 64)
    return F.concat(F.lit("https://t.me/"), F.when(private, F.concat(F.lit("c/"), inner)).otherwise(username), F.lit("/"), msg_id.cast("string"))


def effective_link(source_link: Column, root_link: Column) -> Column:
    return F.coalesce(F.nullif(source_link, F.lit("")), root_link)


def content_hash(question: Column, answer: Column, kind: Column, city: Column, link: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts that matter for search; date and title don't."""
    joined = F.concat(question, F.lit("\n"), answer, F.lit("\n"), kind, F.lit("\n"), F.coalesce(city, F.lit("")), F.lit("\n"), link)
    return F.substring(F.sha2(joined, 256), 1, 16)


# What looks like a phone number, and the punctuation that may follow an address.
PHONE = r"\+?\(?\d[\d\-\s\(\)]{5,}\d"
TAIL = r"^(.*?)([.,!?;:)\]]*)$"


def mask_contacts(text: Column, phones: bool = True, handles: bool = True, placeholder: str = "@username") -> Column:
    """Runs like phone numbers with nine digits or more become as many X; handles of four or more letters a placeholder.

    The replacement's length depends on the match, so the text is cut at the matches and put together again.
    """
    if phones:
        matches = F.regexp_extract_all(text, F.lit(f"({PHONE})"), F.lit(1))
        between = F.split(text, PHONE)
        digits = lambda m: F.regexp_replace(m, r"\D", "")
        masked = F.transform(matches, lambda m: F.when(F.length(digits(m)) >= 9, F.repeat(F.lit("X"), F.length(digits(m)))).otherwise(m))
        text = F.when(F.size(matches) == 0, text).otherwise(F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(masked, i), F.lit("")))), ""))
    return F.regexp_replace(text, r"(?U)@\w{4,}", placeholder.replace("$", r"\$")) if handles else text


def url_label(url: Column, chats: list[dict] | None = None, fallback: str = "ссылка") -> Column:
    """Title of the chat that a link points into, else host and port, else a plain word."""
    out = F.lit(None).cast("string")
    for chat in chats or []:
        marker = f"t.me/c/{str(abs(chat['chat_id']))[3:]}/" if chat.get("private") else f"t.me/{chat['username']}"
        out = F.coalesce(out, F.when(F.contains(url, F.lit(marker)), F.lit(chat["title"])))
    return F.coalesce(out, F.nullif(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), F.lit(fallback))


def url_and_tail(url: Column) -> Column:
    """A bare URL and the punctuation after it."""
    return F.struct(F.regexp_extract(url, TAIL, 1).alias("url"), F.regexp_extract(url, TAIL, 2).alias("tail"))


def citation_left(text: Column) -> Column:
    return text.rlike(r"\[(\d+)")


def date_outside_citation(text: Column, months: list[str] | None = None) -> Column:
    bare = F.regexp_replace(text, r"\([^()]*https?://\S+[^()]*\)", "")
    return bare.rlike(r"(?U)\b(" + "|".join(months or MONTHS) + r")\s+\d{4}\b")


def mentions_place(query: Column, cities: Column, region: str = "[Гг]рузи[а-я]*") -> Column:
    return query.rlike(region) | F.exists(cities, lambda c: F.contains(query, c))


def with_default_city(query: Column, city: Column, cities: Column) -> Column:
    return F.when(city.isNotNull() & (city != "") & ~mentions_place(query, cities), F.concat(query, F.lit(" "), city)).otherwise(query)


def without_mention(text: Column, name: str) -> Column:
    """Text without ``@name`` in any case, where the name isn't the beginning of a longer one."""
    import re

    return strip(F.regexp_replace(text, r"(?iuU)@" + re.escape(name) + r"\b", ""))


def fetch_floor(since: Column, days: int = 30) -> Column:
    """How far back messages are fetched: some days before the cutoff, so that parents of replies are there; null is no floor."""
    return since - F.expr(f"interval {int(days)} days")


def deployment(model: Column, names: dict[str, str] | None = None) -> Column:
    """Name under which a model is deployed; itself where none is set."""
    known = F.create_map(*(F.lit(x) for pair in (names or {}).items() for x in pair)) if names else None
    return model if known is None else F.coalesce(F.try_element_at(known, model), model)


def pretty(x: Column) -> Column:
    """Two decimals, or a dash for null."""
    return F.when(x.isNull(), "  - ").otherwise(F.format_string("%.2f", x))
