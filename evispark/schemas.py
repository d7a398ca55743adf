"""Schemas of the stored tables; never inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "papers": "paper_id string, paper_key string, title string, authors array<string>, year int, file_name string, file_sha256 string, created_at timestamp_ntz",
    "paper_pages": "page_id string, paper_id string, page_number int, text string, created_at timestamp_ntz",
    "sections": "section_id string, paper_id string, title string, section_type string, page_start int, page_end int, start_char int, end_char int, confidence decimal(4,3)",
    "text_chunks": "chunk_id string, paper_id string, page_id string, page_start int, page_end int, start_char int, end_char int, text string, section_title string, section_type string, created_at timestamp_ntz",
    "claim_candidates": "candidate_id string, chunk_id string, claim_text string, claim_type string, normalized_text string, source_quote string, confidence double, model string, created_at timestamp_ntz",
    "extracted_claims": "claim_id string, candidate_id string, claim_text string, claim_type string, normalized_text string, paper_id string, chunk_id string, page int, start_char int, end_char int, confidence double, created_at timestamp_ntz, ingested_at timestamp_ntz, deleted_at timestamp_ntz",
    "syntheses": "synthesis_id string, synthesis_type string, title string, body string, supporting_claim_ids array<string>, supporting_papers int, supporting_claims int, confidence double, created_at timestamp_ntz, ingested_at timestamp_ntz",
    "review_drafts": "review_draft_id string, title string, outline array<string>, markdown string, confidence double, created_at timestamp_ntz",
    "review_sentences": "sentence_id string, review_draft_id string, section_title string, sentence_index int, sentence_text string, supporting_claim_ids array<string>, is_supported boolean, created_at timestamp_ntz, ingested_at timestamp_ntz",
    "embedding_recordings": "vec_id bigint, text_key string, model string, embedding_f16_b64 string, recorded_at timestamp_ntz",
}
#: What a model's answer must look like.
ANSWERS = {
    "claims": "claims array<struct<claim_text: string, claim_type: string, normalized_text: string, source_quote: string, confidence: double>>",
    "syntheses": "syntheses array<struct<synthesis_type: string, title: string, body: string, supporting_claim_ids: array<string>, supporting_papers: int, supporting_claims: int, confidence: double>>",
    "review": "title string, outline array<string>, markdown string, confidence double, sentences array<struct<section_title: string, sentence_index: int, sentence_text: string, supporting_claim_ids: array<string>, is_supported: boolean>>",
}
SNAPSHOT = "version int, created_at string, papers array<struct<key: string, title: string, authors: array<string>, year: int, file_name: string, pdf_sha256: string, pages: map<string, string>, chunks: array<struct<key: string, section_title: string, section_type: string, page_start: int, page_end: int, start_char: int, end_char: int, text: string>>>>"
RECORDING = "key string, model string, prompt_version string, temperature double, input_tokens bigint, output_tokens bigint, latency_s double, recorded_at string, parsed string"


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


TABLES = tuple(_DDL)
