"""Published result tables used as inputs of the derived figures.

Fixed values. Labels are translated: the total line is ALL.
"""

FUNNEL = ["sessions", "viewed_mono", "cart_mono", "checkout_mono", "purchase_mono",
          "viewed_strict", "cart_strict", "checkout_strict", "purchase_strict"]

BY_CHANNEL = [
    ("ALL", 879171, 130006, 52282, 22031, 11398, 121921, 43697, 17042, 9078),
    ("Organic Search", 381137, 65448, 23370, 8198, 3443, 62597, 20332, 6562, 2814),
    ("Social", 224422, 5117, 1653, 346, 61, 4577, 1107, 230, 39),
    ("Direct", 142856, 23609, 10124, 4335, 2060, 21073, 7516, 2867, 1442),
    ("Referral", 82835, 27076, 13745, 8014, 5213, 25290, 11757, 6477, 4279),
    ("Paid Search", 25290, 5276, 2005, 768, 469, 5064, 1771, 614, 377),
    ("Affiliates", 16372, 1945, 816, 138, 9, 1859, 723, 109, 9),
    ("Display", 6259, 1535, 569, 232, 143, 1461, 491, 183, 118),
]
BY_DEVICE = [
    ("ALL", 879171, 130006, 52282, 22031, 11398, 121921, 43697, 17042, 9078),
    ("desktop", 640959, 98774, 42079, 18979, 10376, 92520, 35408, 14843, 8302),
    ("mobile", 207922, 27366, 8884, 2669, 854, 25768, 7215, 1920, 653),
    ("tablet", 30290, 3866, 1319, 383, 168, 3633, 1074, 279, 123),
]
BY_VISITOR = [
    ("ALL", 879171, 130006, 52282, 22031, 11398),
    ("new", 689985, 85891, 30152, 10434, 4438),
    ("returning", 189186, 44115, 22130, 11597, 6960),
]
BY_VARIANT = [
    ("no_hidden_referral", "desktop", 572564, 73637, 28974, 11184, 5247, 69036, 24153, 8514, 4071),
    ("no_hidden_referral", "mobile", 207480, 27326, 8862, 2661, 849, 25735, 7200, 1915, 650),
    ("no_hidden_referral", "tablet", 30267, 3859, 1316, 380, 166, 3627, 1072, 277, 122),
    ("no_social", "desktop", 443227, 95450, 40967, 18689, 10322, 89498, 34602, 14642, 8267),
    ("no_social", "mobile", 184993, 25773, 8399, 2620, 849, 24389, 6945, 1894, 650),
    ("no_social", "tablet", 26529, 3666, 1263, 376, 166, 3457, 1043, 276, 122),
    ("no_both", "desktop", 374832, 70313, 27862, 10894, 5193, 66014, 23347, 8313, 4036),
    ("no_both", "mobile", 184551, 25733, 8377, 2612, 844, 24356, 6930, 1889, 647),
    ("no_both", "tablet", 26506, 3659, 1260, 373, 164, 3451, 1041, 274, 121),
    ("all", "desktop", 640959, 98774, 42079, 18979, 10376, 92520, 35408, 14843, 8302),
    ("all", "mobile", 207922, 27366, 8884, 2669, 854, 25768, 7215, 1920, 653),
    ("all", "tablet", 30290, 3866, 1319, 383, 168, 3633, 1074, 279, 123),
]
CONFOUND = [
    ("ALL", 11398, 18.4), ("Organic Search", 3443, 16.15), ("Social", 61, 34.43), ("Direct", 2060, 28.98),
    ("Referral", 5213, 15.79), ("Paid Search", 469, 16.42), ("Affiliates", 9, 0.0), ("Display", 143, 16.08),
]
CROSS = [
    ("Affiliates", "desktop", 14803, 1718, 7, 0.047), ("Affiliates", "mobile", 1361, 127, 2, 0.147),
    ("Affiliates", "tablet", 208, 14, 0, 0.0), ("Direct", "desktop", 87980, 15168, 1800, 2.046),
    ("Direct", "mobile", 49504, 5285, 223, 0.45), ("Direct", "tablet", 5372, 620, 37, 0.689),
    ("Display", "desktop", 4564, 1154, 134, 2.936), ("Display", "mobile", 1536, 286, 9, 0.586),
    ("Display", "tablet", 159, 21, 0, 0.0), ("Organic Search", "desktop", 245480, 43667, 2823, 1.15),
    ("Organic Search", "mobile", 117517, 16461, 513, 0.437), ("Organic Search", "tablet", 18140, 2469, 107, 0.59),
    ("Paid Search", "desktop", 12657, 3111, 359, 2.836), ("Paid Search", "mobile", 10532, 1686, 93, 0.883),
    ("Paid Search", "tablet", 2101, 267, 17, 0.809), ("Referral", "desktop", 77743, 24680, 5199, 6.687),
    ("Referral", "mobile", 4543, 544, 9, 0.198), ("Referral", "tablet", 549, 66, 5, 0.911),
    ("Social", "desktop", 197732, 3022, 54, 0.027), ("Social", "mobile", 22929, 1379, 5, 0.022),
    ("Social", "tablet", 3761, 176, 2, 0.053),
]
COUNTRIES = [
    ("United States", 355620, 83829, 35475, 16900, 10838), ("India", 49983, 5245, 2119, 611, 10),
    ("United Kingdom", 36533, 3280, 1024, 288, 16), ("Canada", 25001, 5530, 2402, 793, 191),
    ("Vietnam", 24514, 369, 99, 18, 0),
]
REV_HITS = [
    (0, 37), (1, 11165), (2, 282), (3, 31), (4, 12), (5, 9), (6, 5), (7, 3), (8, 3), (10, 1), (12, 1), (15, 1),
    (21, 1), (25, 1),
]
INTERNAL = [
    ("analytics.google.com", "referral", 16172, 0), ("sites.google.com", "referral", 2983, 42),
    ("mail.google.com", "referral", 1457, 62), ("groups.google.com", "referral", 1025, 38),
    ("plus.google.com", "referral", 524, 5), ("docs.google.com", "referral", 388, 1),
]
