"""The index tables."""

SOURCES = "library_id string, source_id string, rel_path string, name string, ext string, kind string, size bigint, mtime double, fingerprint string, status string, priority int, taken_at timestamp, folder string, meta_json string"
CHUNKS = "chunk_id bigint, source_id string, kind string, text string, heading string, page int, ts_start double, ts_end double, ord int"
VECTORS = "id bigint, space string, entity_id bigint, source_id string, emb array<float>"
FACES = "id bigint, source_id string, ts double, det_score double, quality double, person_id string, person_locked boolean, track_id int"
HITS = "retriever string, library_id string, source_id string, kind string, entity_id bigint, score double"
