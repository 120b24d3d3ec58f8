"""Small source trees written by tests."""

import os

#: A kiln: nested modules, a mod.rs that imports in a circle, a script, and imports that lead nowhere.
SAMPLE = {
    "src/main.rs": "mod furnace;\nmod glaze;\n\nuse furnace::Furnace;\nuse serde::Serialize;\n\nfn main() {\n    Furnace::lit(900).bake();\n}\n",
    "src/furnace.rs": "mod valve;\n\nuse crate::glaze::Coat;\n\npub struct Furnace {\n    heat: u32,\n}\n\nimpl Furnace {\n    pub fn lit(heat: u32) -> Self {\n        Furnace { heat }\n    }\n\n    pub fn bake(&self) -> Coat {\n        Coat::Matte\n    }\n}\n\nfn cool() {}\n",
    "src/furnace/valve.rs": "pub enum Valve {\n    Open,\n    Shut,\n}\n\npub trait Turn {}\n",
    "src/glaze/mod.rs": "mod tint;\n\npub enum Coat {\n    Matte,\n}\n",
    "src/glaze/tint.rs": "use super::Coat;\nuse crate::glaze::Coat as Again;\n\nfn mix() {}\n",
    "tools/fire.py": "import json\nfrom os import path\n\nclass Kiln:\n    def fire(self):\n        pass\n",
    "Makefile": "all:\n",
}
SOURCES = sorted(p for p in SAMPLE if p != "Makefile")


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as file:
            file.write(text if isinstance(text, bytes) else text.encode())
    return str(root)
