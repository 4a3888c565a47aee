"""Small embedded tables for the golden tests (annual history 2005–2017 in
millions of passengers, population in millions), the published parameter
values, and the stored golden predictions."""

# Fixed values. year, actual, population, gdp, price — the four-model input
INPUT = [
    (2005, 20.885504, 327.71977, 48616.9998227449, 292.04155113426793),
    (2006, 20.826152, 330.90845, 49430.399858329394, 289.3657355684126),
    (2007, 21.926944, 334.07888, 49845.50953954348, 288.7781942282772),
    (2008, 21.922236, 337.29277, 49287.76564051462, 298.0172093658397),
    (2009, 22.651661, 340.3531, 47480.61351578699, 255.5971646883337),
    (2010, 22.58783, 343.2966, 48290.42291709268, 269.61527631170196),
    (2011, 23.808158, 345.94615, 48759.91537989367, 295.9071359764292),
    (2012, 24.859235, 348.69038, 49429.189873262345, 282.20803226645097),
    (2013, 25.46468, 351.33418, 49918.519171690044, 267.2080119497623),
    (2014, 26.713817, 354.11012999999997, 50813.69742232452, 248.9196221754133),
    (2015, 27.877971, 356.84425000000005, 51774.290884608614, 207.77655481810643),
    (2016, 28.141409, 359.61115, 52135.36621431232, 178.97222868626946),
    (2017, 29.411726, 362.37624999999997, 52952.77491281507, 175.62404481924125),
]

# the one-country input of the saturation model
FULL_INPUT = [
    (2005, 20.885504, 32.20277, 47344.12598667754, 292.04155113426793),
    (2006, 20.826152, 32.52865, 48099.35241702315, 289.3657355684126),
    (2007, 21.926944, 32.84768, 48614.75757191985, 288.7781942282772),
    (2008, 21.922236, 33.19857, 48582.12266371715, 298.0172093658397),
    (2009, 22.651661, 33.5811, 46612.052612928106, 255.5971646883337),
    (2010, 22.58783, 33.9586, 47515.15080126979, 269.61527631170196),
    (2011, 23.808158, 34.302150000000005, 48516.92969682658, 295.9071359764292),
    (2012, 24.859235, 34.697379999999995, 48801.4657014449, 282.20803226645097),
    (2013, 25.46468, 35.09938, 49436.54275374665, 267.2080119497623),
    (2014, 26.713817, 35.48713, 50292.73993134976, 248.9196221754133),
    (2015, 27.877971, 35.80425, 50346.20191737014, 207.77655481810643),
    (2016, 28.141409, 36.20515, 50492.789009298394, 178.97222868626946),
    (2017, 29.411726, 36.65725, 51389.779647955045, 175.62404481924125),
]

# Published parameter values (fixed values).
FULL = {"distribution_a": 1.1572, "distribution_b": 4.3517429, "k1": -6.59917386, "k2": 0.39546328,
        "full_price_scale": 30.0, "full_penetration": 0.8193343775346827}
LINEAR = {"C1": -0.13504193193763592, "C2": 0.21316556991134572}
INDEXED = {"distribution_a": 1.1572, "distribution_b": 4.3517429, "k1": -6.59917386, "k2": 0.39546328,
           "ref_year": 2015, "ref_gdp_per_capita": 51774.290884608614,
           "ref_normalized_traffic": 0.0781236379737098, "ref_elasticity": -1.728566864526717,
           "fare_growth_rate": 0.0}

# The stored golden predictions of every year from 2018 on.
GOLDEN = {
    "logistic_price": [
        29.59355076797288, 29.937566431163717, 30.284975253538306, 30.635811202704694, 30.990108605271875,
        31.347902150006522, 31.709226891028223, 32.07411825104386, 32.442612024621205, 32.81474438150235,
        33.19055186995724, 33.5700714201777, 33.95334034771232, 34.34039635694257, 34.73127754460057,
        35.126022403328776, 35.52466982528207, 35.92574531778027, 36.28500277095806, 36.64785279866765,
        37.01433132665432, 37.38447463992087, 37.75831938632008, 38.13590258018328, 38.51726160598511,
        38.90243422204496, 39.291458564265405, 39.68437314990807, 40.08121688140715, 40.48202905022122,
        40.88684934072344, 41.29571783413066,
    ],
    "linear_price": [
        35.218976277819635, 35.75418205347747, 36.294775423981775, 36.8408102721814, 37.39234101975506,
        37.94942263259957, 38.51211062627206, 39.0804610714866, 39.654530599665684, 40.234376408547455,
        40.82005626784866, 41.41162852498469, 42.009152110846344, 42.612686545634695, 43.22229194475416,
        43.83802902476458, 44.45995910939267, 45.088144135603834, 45.72264665973438, 46.36352986368543,
        47.01085756117838, 47.66469420407325, 48.32510488874991, 48.992155362553476, 49.66591203030381,
        50.34644196087028, 51.03381289381238, 51.7280932460865, 52.42935211881992, 53.13765930415258,
        53.85308529214714, 54.57570127776824,
    ],
    "trend_elasticity_blend": [
        29.856356698631895, 30.47409365318908, 31.100869597117505, 31.736803472409335, 32.38201569598518,
        33.036628177298475, 33.70076433614444, 34.37454912067601, 35.05810902562891, 35.751572110758595,
        36.4550680194911, 37.16872799779055, 37.89268491324544, 38.627073274376706, 39.37202925016943,
        40.12769068983142, 40.89419714278066, 41.67168987886464, 42.460311908814, 43.26020800493317,
        44.071524722030844, 44.894410418592734, 45.729015278199725, 46.57549133119382, 47.43399247659512,
        48.304674504272285, 49.18769511736955, 50.0832139549934, 50.9913926151613, 51.912394678016206,
        52.846385729309084, 53.79353338415319,
    ],
    "linear_income_index": [
        30.045854563536068, 31.492907729347746, 32.932167453610234, 34.36398811206741, 35.78871922984856,
        37.20670559595974, 38.61828737575508, 40.02380022142925, 41.42357538057148, 42.817939802821094,
        44.20721624466321, 45.59172337240311, 46.97177586335645, 48.34768450529255, 49.71975629416639,
        51.0882945301752, 52.45359891217383, 53.815965630483795, 55.1756874581285, 56.53305384052854,
        57.888350983688106, 59.24186194090541, 60.59386669803702, 61.94464225734726, 63.29446271997237,
        64.64359936702854, 65.992320739393, 67.3408927161861, 68.68957859198208, 70.03863915277616,
        71.38833275073398,
    ],
    "implied_price_logistic": [
        31.210817807874637, 33.07607713058012, 35.00667166461876, 37.00155273642787, 39.05946275006801,
        41.178944841027594, 43.35835459115657, 45.59587362044322, 47.88952483698531, 50.23718909808013,
        52.63662301361759, 55.08547760839829, 57.58131755281119, 60.121640671420344, 62.70389744608456,
        65.32551024368996, 67.9838920176472, 70.67646425607099, 73.40067397700263, 76.15400960109838,
        78.93401556381279, 81.73830556125658, 84.56457435564735, 87.41060809678646, 90.27429314458313,
        93.15362340374858, 96.04670620500184, 98.95176678717587, 101.86715145137225, 104.79132947175447,
        107.72289385778348,
    ],
}

# Expected file's future drivers and the spreadsheet's implied-price column.
# year, population, gdp per head, spreadsheet forecast
EXPECTED_PATH = [
    (2018, 364.95727, 54045.14616, 30.65429391), (2019, 367.67382, 54810.20378, 31.60830621),
    (2020, 370.37915, 55228.42201, 32.23938307), (2021, 373.07218, 55726.16002, 32.95033848),
    (2022, 375.74933, 56312.76042, 33.75069178), (2023, 378.40428, 56933.94641, 34.58834549),
    (2024, 381.0336, 57573.52632, 35.4473926), (2025, 383.6341, 58234.16896, 36.32995333),
    (2026, 386.20785, 58917.79517, 37.23788935), (2027, 388.7457, 59627.7155, 38.17328702),
    (2028, 391.2443, 60360.54455, 39.13220196), (2029, 393.69755, 61113.03969, 40.110458),
    (2030, 396.10305, 61886.70095, 41.10877119), (2031, 398.45727, 62666.22516, 42.11138171),
    (2032, 400.76102, 63475.42483, 43.14087196), (2033, 403.01252, 64313.58758, 44.19566259),
    (2034, 405.21155, 65167.21451, 45.26195708), (2035, 407.3616, 66033.07234, 46.33633811),
    (2036, 409.4623, 66907.94733, 47.41501448), (2037, 411.5161, 67793.50553, 48.4992083),
    (2038, 413.5273, 68689.36344, 49.58841032), (2039, 415.49578, 69595.21466, 50.68168268),
    (2040, 417.42615, 70514.68865, 51.78236111), (2041, 419.32118, 71447.72415, 52.89006822),
    (2042, 421.18492, 72389.72136, 54.00041361), (2043, 423.02158, 73340.39554, 55.11313439),
    (2044, 424.83403, 74299.15631, 56.2275585), (2045, 426.62895, 75266.02449, 57.34412373),
    (2046, 428.41058, 76241.77489, 58.46367146), (2047, 430.18215, 77225.21495, 59.58517239),
    (2048, 431.9479, 78215.69685, 60.7082879), (2049, 433.71268, 79213.3654, 61.83352067),
]

PANEL_SCHEMA = "series_id BIGINT, year INT, actual DOUBLE, population DOUBLE, gdp DOUBLE, price DOUBLE"


def panel(spark, rows, series_id=1):
    return spark.createDataFrame([(series_id, *r) for r in rows], PANEL_SCHEMA)
