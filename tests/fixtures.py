"""Source trees of our own that show the constructs the extractors and resolvers handle."""

PYTHON = {
    "app/__init__.py": "",
    "app/models.py": '''class Base:
    def save(self):
        return True


class User(Base):
    def __init__(self, name):
        self.name = name

    @property
    def label(self):
        return self.format()

    def format(self):
        def inner():
            return 1
        return inner()


def make(name):
    return User(name)


double = lambda x: x * 2
''',
    "app/api.py": "from .models import make, User as Person\nfrom app.util import *\nimport app.util as util\nimport json\n\n\ndef run():\n    u = Person('é')\n    u.save()\n    make('x')\n    helper()\n    util.helper()\n    json.dumps({})\n",
    "app/util.py": "from .models import make as build\n\n\ndef helper():\n    return build('y')\n",
    "app/deep/chain.py": "from ..util import build\n\nbuild('z')\n",
    "broken.py": "def (:\n",
}
JAVA = {
    "src/com/x/Foo.java": "package com.x;\n\nimport java.util.List;\n\npublic class Foo extends Bar {\n    private final List<String> names = null;\n\n    public Foo() {\n        super();\n    }\n\n    // not a call: ghost()\n    public void run(Bar other) {\n        other.greet();\n        greet();\n        Helper h = new Helper();\n        h.assist(\"run()\");\n    }\n}\n",
    "src/com/x/Bar.java": "package com.x;\n\npublic class Bar {\n    public String greet() {\n        return \"hi\";\n    }\n\n    enum Kind { A, B }\n}\n",
    "src/com/x/Helper.java": "package com.x;\n\nclass Helper {\n    void assist(String s) {\n    }\n}\n",
}
KOTLIN = {
    "k/Main.kt": "package k\n\nimport k.lib.greet as hello\n\ndata class Point(val x: Int)\n\nclass Runner : Base() {\n    fun go() {\n        hello()\n        step()\n    }\n}\n\nopen class Base {\n    fun step(): Point {\n        return make()\n    }\n}\n\nfun make(): Point = Point(1)\n",
    "k/lib/Lib.kt": "package k.lib\n\nfun greet() {\n}\n\nfun String.shout(): String {\n    return this\n}\n",
}
TYPESCRIPT = {
    "web/main.ts": "import fs, { readFile as rf } from 'fs';\nimport * as path from \"path\";\nimport './side';\n\nexport class Store {\n  get(key: string): string {\n    return load(key);\n  }\n}\n\nfunction load(key: string) {\n  return key;\n}\n\nconst twice = (n: number) => {\n  return n * 2;\n};\n",
}
RUBY = {
    "lib/auth.rb": "require 'json'\nrequire_relative \"user\"\n\nmodule Auth\n  class Session < Base\n    def self.open(name)\n      user = User.new(name)\n      user.greet\n    end\n\n    def close\n      helper()\n    end\n\n    def helper\n      if true\n        1\n      end\n    end\n  end\nend\n",
    "lib/user.rb": "class User\n  def initialize(name)\n    @name = name\n  end\n\n  def greet\n    puts @name\n  end\nend\n",
}
CSHARP = {"App.cs": "using System;\nusing Text = System.Text;\n\nnamespace App {\n    public class Program {\n        public int Size { get; set; }\n        public static void Main(string[] args) {\n            Run();\n        }\n        void Run() { }\n    }\n    struct Pair { }\n}\n"}
RUST = {"lib.rs": "use std::{fmt, collections::HashMap as Map};\nuse crate::a::*;\n\npub struct Point { x: i32 }\n\nimpl Point {\n    pub fn new() -> Self { Point { x: 0 } }\n}\n\nmod inner {\n    pub fn f() {}\n}\n"}
