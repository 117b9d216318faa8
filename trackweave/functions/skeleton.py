"""Joint names, bones and angle definitions.  Fixed values that results depend on."""

COCO_17 = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow",
    "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle",
    "right_ankle",
)
H36M_17 = (
    "pelvis", "right_hip", "right_knee", "right_ankle", "left_hip", "left_knee", "left_ankle", "spine", "thorax",
    "neck", "head", "left_shoulder", "left_elbow", "left_wrist", "right_shoulder", "right_elbow", "right_wrist",
)
COCO_BONES = (
    (0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13),
    (13, 15), (12, 14), (14, 16),
)
H36M_BONES = (
    (0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 6), (0, 7), (7, 8), (8, 9), (9, 10), (8, 11), (11, 12), (12, 13),
    (8, 14), (14, 15), (15, 16),
)
# the angle is measured at the middle joint
ANGLES = (
    (1, 2, 3), (4, 5, 6), (0, 1, 2), (0, 4, 5), (14, 15, 16), (11, 12, 13), (8, 14, 15), (8, 11, 12), (0, 7, 8),
    (8, 9, 10), (7, 8, 14), (7, 8, 11),
)
MIRROR_PAIRS = ((1, 4), (2, 5), (3, 6), (11, 14), (12, 15), (13, 16))
