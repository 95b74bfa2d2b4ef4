"""SHA-256 and length of the canonical form of entire licences, as the system's common-licenses folder has them."""

#: Licence, digest, characters of the canonical form.
DIGESTS = (
    ("Apache-2.0", "a1fcff61f6fa8f2adaddde16b467fddc8df407ec6f54c9e05dac4367971c951c", 9875),
    ("GPL-2.0", "9a5a19210270371ce5a39629bd002be79dce34ff4b5809740a51d10bc8384fba", 17114),
    ("GPL-3.0", "004e92bf8f5e055d69d79ae062a077cdef0f725fa6dca3759d52e8dd2ef5d1c5", 33403),
    ("LGPL-2.1", "4d7a79ab2b6b5cc10b608790ddd346ae56a76304cf830dddc808227a0152e6f9", 25213),
    ("LGPL-3.0", "ff8578eeb77104c46c3df87bc2658d2cda9d6cde5f8ba73e406c267005d35633", 7102),
    ("MPL-2.0", "3a4f7585dcc42cefd614b019e7b34b82d8a51faed99e804ec46e8420f8ab964d", 14335),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GPL-1.0", "044ff10d427a4e3a053fa8cbe99c8795e55743799a48c576bf47a62b139e70d2", 11761),
    ("LGPL-2.0", "ef858a0bb78690cb8551d3e507685562363a8ac82abdf61ce73181d21b0bda9e", 24126),
    ("MPL-1.1", "7f89793c3cb92f612fffdd462abe3cc4f187faa1b8f5232201afcaab98eb47b9", 22440),
    ("GFDL-1.2", "e54ee8a923191f6e1e23c41d37a4acb50b4ba356fa58fe5f9ff91d781b35d585", 19578),
    ("GFDL-1.3", "ccef239928e90c997c189e718035b2e573332aa25b00928140091160ee3c1f49", 22013),
    ("Artistic-1.0", "232d0226cd433703c8e2c5eb4927ad9a8ee5d0ac063ccb0ca1a301a2133059ce", 5826),
)
