"""A small merge table for the queries: learned with operators.bpe.train on the 1,000 documents of scale 0.01."""

MERGES = [
    (121, 109), (37, 106), (37, 261), (116, 115), (110, 115), (119, 106), (37, 102), (121, 110),
    (109, 106), (106, 119), (115, 105), (113, 106), (37, 116), (37, 200), (106, 115), (104, 109),
    (120, 121), (263, 106), (102, 115), (262, 119), (268, 264), (37, 105), (109, 102), (37, 264),
    (116, 122), (262, 115), (113, 126), (116, 119), (265, 108), (102, 121), (115, 121), (103, 272),
    (106, 102), (124, 109), (106, 120), (104, 110), (120, 109), (267, 115), (200, 184), (122, 106),
    (273, 107), (37, 266), (37, 265), (274, 174), (296, 299), (110, 121), (110, 106), (106, 105),
    (37, 121), (305, 115), (37, 269), (118, 300), (122, 125), (275, 121), (200, 174), (37, 113),
    (267, 271), (114, 314), (38, 38), (42, 42), (47, 47), (282, 106), (43, 43), (41, 41),
]
