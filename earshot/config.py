"""Thresholds of the corpus operators. All can be overridden by argument."""

#: Gates, segmentation, clustering, linking, splits.
MUSIC_REJECT_PROB = 0.60
SPEECH_KEEP_PROB = 0.50
MIN_SPEECH_RATIO = 0.75
SNR_REJECT_FLOOR_DB = 3.0
SNR_CLEAN_DB = 15.0
MIN_DURATION = 3.0
MAX_DURATION = 10.0
GAP_TOLERANCE = 0.5
SPLIT_WINDOW_S = 0.2
MAD_MULTIPLIER = 2.5
AHC_THRESHOLD = 0.30
KNEE_SENSITIVITY = 1.0
MERGE_AUTO_SIM = 0.70
MERGE_REVIEW_SIM = 0.60
MERGE_REVIEW_Z = 4.0
MERGE_MIN_SEGMENTS = 3
LINK_AUTO_SIM = 0.72
LINK_REVIEW_SIM = 0.65
LINK_CROSS_SIM = 0.70
FLOOR_SEGMENTS = 5
FLOOR_SECONDS = 45.0
SPLIT_TARGETS = {"train": 0.8, "dev": 0.1, "test": 0.1}
SEED = 1337
KEEP_TIERS = ("Tier1", "Tier2")
Z95 = 1.959964
EXCLUSION_PRIORITY = ("music", "low_speech", "low_snr")
EOF_REASON = "empty_slice"
TRUE_TEXTS = ("true", "1", "1.0", "yes")
BLANK_TEXTS = ("", "na", "nan", "none")
