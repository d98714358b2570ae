"""Explicit schemas of the records that readers take; nothing is inferred from data."""

DOCUMENT = "source_id string, source_type string, title string, content string, content_type string, metadata map<string,string>"

WIKI_PAGE = (
    "id string, title string, space struct<key:string>, version struct<number:int,when:string,by:struct<displayName:string>>, "
    "body struct<storage:struct<value:string>,view:struct<value:string>>, labels array<string>, "
    "restrictions struct<read:struct<restrictions:array<struct<subjects:array<struct<identifier:string,type:string>>>>>>"
)
ISSUE = (
    "key string, fields struct<summary:string,description:string,status:struct<name:string>,priority:struct<name:string>,"
    "assignee:struct<displayName:string>,updated:string,security:struct<name:string,id:string>,project:struct<key:string>,"
    "comment:struct<comments:array<struct<author:struct<displayName:string>,body:string>>>>"
)
COMMIT = "id string, short_id string, title string, message string, author_name string, author_email string, created_at string, diffs array<struct<new_path:string,diff:string>>"
MERGE_REQUEST = "iid long, title string, description string, state string, updated_at string, discussions array<struct<notes:array<struct<author:string,body:string>>>>"
CODE_FILE = "path string, language string, content string"

CHAT = "title string, messages array<struct<role:string,content:string,create_time:double>>, mapping map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>>>"
EVAL = "query string, relevant_docs array<string>, notes string"
AUDIT = "id string, timestamp string, type string, user string, ip string, endpoint string, hash string, details map<string,string>, duration_ms double, tokens_used long, status string"
FEEDBACK = "feedback_id string, interaction_id string, user_id string, role string, rating string, confidence double, retrieval_quality int, question string, answer string, correction string, comment string, kb_id string, model string, sources_json string, chunk_feedback_json string, created_at string, updated_at string, status string, language string, tags string"
KNOWLEDGE_BASE = "kb_id string, name string, description string, status string, doc_count long, created_at double, updated_at double, deleted_at double"
ETL_TASK = "task_id string, kb_id string, source string, status string, progress double, error string, started_at double, finished_at double"
DLQ = "id string, payload string, error string, status string, retry_count int, next_retry_at double, created_at double"
STREAM_EVENT = "source string, event_type string, doc_id string, timestamp string, payload string"
