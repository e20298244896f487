"""Schemas of the image store."""

SCHEMAS = {
    "program": "id int, run_id bigint",
    "runs": "id bigint, timestamp bigint",
    "images": "id bigint, path string, user string",
    "run_images": "id bigint, run_id bigint, image_id bigint",
    "modifications": "id int, name string",
    "hashing_methods": "id int, name string",
    "modified_images": "id bigint, image_id bigint, modification_id int",
    "hashes": "id bigint, hash binary, words array<bigint>, nbits int, mod_image_id bigint, hashing_method_id int",
    "matches": "id bigint, hamming_distance int, hash_len int, hash1_id bigint, hash2_id bigint, run_id bigint",
}
