"""Row types of inputs, stages and reports."""

# Column names and types of requests, stages and reports, in order.
REQUEST = "type_of_check string, tenant string, locale string, format string, data string, report_id string"
SPAN = "st int, en int, cat string, val string"
MASKING = "_id string, report_id string, toc_type string, tenant string, locale string, body string, message_01 string, layers array<struct<type:string,map:map<string,string>>>, order array<string>, created_at string, created_at2 string"
MIRROR_COLUMNS = ["_id", "report_id", "toc_type", "tenant", "locale", "message_01", "layers", "created_at", "created_at2"]
QA_COLUMNS = ["no", "report_id", "type_of_check", "tenant", "locale", "processed_at", "before", "report_01", "pii_dictionary", "llm_prompt", "report_02", "report_03", "final_report"]
RATE_EVENT = "key string, ts timestamp"
