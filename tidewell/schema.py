"""The store's tables. ``entries.message_pk`` is ``messages.id``."""

MESSAGES = "id long, chat_id string, message_id long, published_at string, sender_name string, source_text string, source_url string, media_type string, media_group_id string, imported_at timestamp"
ENTRIES = "message_pk long, period_key string, eligible int, category_code string, category_title string, category_emoji string, short_title string, confidence string, provider string, manual_title string, manual_category string, excluded_reason string"
PUBLICATIONS = "period_key string, destination string, part_no int, telegram_message_id long, rendered_html string, sent_at string"
EDITIONS = "period_key string, destination string, edition string, version long, part_no int, total int, html string"
#: Edits of fields by hand, as an append-only log of a period; see operators/moderation.py.
ACTIONS = "action_id long, at timestamp, actor string, kind string, period_key string, message_pk long, field string, value string, target long"
#: What a text was classified as in a period, by the hash of its prepared form.
RESULTS = "period_key string, text_hash string, eligible int, category string, category_title string, category_emoji string, title string, confidence string, provider string"
#: What live updates say of each message; a deletion that came before its message has no period yet.
STATES = "period_key string, chat_id string, message_id long, sent_at timestamp, at timestamp, update_id long, words string, media_group_id string, deleted boolean"
#: Of a version: where each table's rows of a period are.
MANIFEST = "table_name string, period_key string, folder string, rows long, top long"
