"""Schemas of the tables that readers and operators hand on."""

MATRIX_ROWS = "file_name string, sheet_idx int, sheet_name string, row_index int, cells array<string>"
BLOCKS = "source_file string, block_id int, block_type string, heading_level int, section_context string, text string, is_template boolean, table_header string"
IMAGES = "source_file string, section string, image_name string, content_type string, n_bytes long, image binary"
VECTORS = "source_code string, chunk_id int, text string, embedding array<float>"
CORRUPT = "_corrupt"
