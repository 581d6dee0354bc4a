"""Fixed schemas of the stored datasets. JSON lines are always read with one of these, never inferred."""

from __future__ import annotations

MESSAGE = "chat_username string, chat_title string, msg_id bigint, date string, sender string, sender_id bigint, text string, reply_to bigint, link string"
CHAT = "username string, chat_id bigint, title string, private boolean"
UNIT = (
    "pos bigint, question string, answer string, type string, city string, date string, chat_username string, chat_title string, "
    "root_msg_id bigint, root_link string, source_msg_id bigint, source_link string, judge_note string, reverify_note string"
)
JUDGEMENT = (
    "pos bigint, root_msg_id bigint, root_link string, question string, answer string, type string, city string, faithful boolean, atomic boolean, "
    "useful boolean, type_ok boolean, type_suggested string, city_ok boolean, city_suggested string, verdict string, note string"
)
VECTOR = "id string, embedding array<float>, document string, question string, answer string, type string, city string, date string, chat_title string, chat_username string, link string, content_hash string"
GOLDEN = "id string, query string, category string, subtype string, notes string"
INTERACTION = "ts string, user_id bigint, username string, history array<struct<role:string,content:string>>, question string, answer string, source string, chat_type string, label string, raw_text string"
CURSOR = "chat_username string, processed_until string"
