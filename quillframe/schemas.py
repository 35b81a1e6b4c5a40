"""Schemas of the job store, as DDL."""

from __future__ import annotations

JOBS = "id string, title string, source_video_path string, status string, duration_ms bigint, frame_count int, screenshot_count int, recipient string, perm_id string, date_of_service string, state string, case_type string, sample string, created_at timestamp, updated_at timestamp"
FRAMES = "id string, job_id string, frame_index int, timestamp_ms bigint, source_image_path string, blur_score double, stability_score double, relevance_score double, matched_keywords array<string>, extracted_text string, ocr_confidence double, candidate_score double"
ENTITY = "struct<text:string,type:string,start:int,end:int>"
SCREENSHOTS = f"id string, job_id string, source_frame_id string, image_path string, thumbnail_path string, captured_at_ms bigint, section_type string, confidence double, rationale string, matched_keywords array<string>, entities array<{ENTITY}>, extracted_text string, accepted boolean, notes string, order_index int"
SECTIONS = "id string, job_id string, screenshot_id string, heading string, section_type string, summary string, key_points array<string>, confidence double, final_order int"
REPORTS = "id string, job_id string, html_path string, pdf_path string, created_at timestamp"
CLASSIFICATION_RESULTS = "id bigint, job_id string, frame_id string, filename string, classifier_label string, classifier_confidence double, svm_label string, svm_confidence double, lr_label string, lr_confidence double, all_svm_probs map<string,double>, all_lr_probs map<string,double>, tfidf_top_keywords array<string>, table_row_count int, table_text_ratio double, avg_cells_per_row double, created_at timestamp"

# States of a job.
JOB_STATUS = ["pending", "processing", "completed", "failed"]
TABLES = {"jobs": JOBS, "frames": FRAMES, "screenshots": SCREENSHOTS, "sections": SECTIONS, "reports": REPORTS, "classification_results": CLASSIFICATION_RESULTS}
