"""Schemas of what the engine reads and makes."""

PAGE = "page_idx long, title string, url string, content string"
CONFIG = "config_id long, directory string, config variant"
#: A configuration, exploded: ``pos`` is the key's place, ``value_json`` its canonical text.
CONFIG_KV = "config_id long, pos int, tag string, value variant, value_json string"
TAG = "title string, value string, default string, description string, related array<string>, url string, auto_generated boolean"
NON_TAG = "title string, type string, summary string, url string, is_file_page boolean"
TAG_STATS = "tag string, count long, total_configs long, frequency double, top_values array<struct<value:string,count:long>>"
TAG_CONTEXTS = "tag string, total long, common_contexts array<struct<context:map<string,string>,count:long>>"
COOCCURRENCE = "a string, b string, n long"
ALIAS = "alias string, target string"
SEARCH_DOC = "doc_id string, title string, text string, type string"
VECTOR = "doc_id string, title string, type string, embedding array<float>"
CHUNK = "chunk_id string, title string, url string, start_index int, chunk string"
FETCH_META = "last_fetch timestamp, last_modified string, page_count long, page_titles_md5 string, page_titles array<string>"
FORMAT_VERSION = "0.2.0"
