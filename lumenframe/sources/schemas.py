"""Schemas of the tables that pipelines exchange."""

ITEMS = "video string, video_id string, label_name string, label int, split string"
MANIFEST = "video_id string, class string, label int, split string, caption string, original_relpath string"
RETRIEVAL = "video_id string, video string, caption string"
TAXONOMY = "id string, caption string, kind string, window int, threshold double, min_consec int"
PROMPTS = "map<string, struct<caption: string, label: int, kind: string, window: int, threshold: double, min_consec: int>>"
ANNOTATIONS = "video string, class string, start_sec double, end_sec double"
CHUNKS = "chunk_id string, source_video string, split string, start_sec double, end_sec double, labels string, jitter int"
EMBEDDINGS = "id string, label long, split string, embedding array<float>"
SCORES = "video string, class string, start_sec double, score double"
EVENTS = "map<string, map<string, array<struct<start_sec: double, end_sec: double, peak: double, mean: double, n_windows: int>>>>"
THRESHOLDS = "map<string, struct<threshold: double, window: int, min_consec: int, val_f1: double, val_tp: int, val_fp: int, val_fn: int>>"
HEADS = "class string, w array<double>, b double, t_lo double, t_hi double, c_reg double, encoder string"
REVIEW = "video string, class string, start_sec double, end_sec double, peak_p double"
METRICS = "phase string, metric string, value double"
